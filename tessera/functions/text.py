"""Column functions on texts and their bytes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token: a run of ASCII letters and digits; every other byte separates.
TOKEN = "[A-Za-z0-9]+"
#: Where snippets may begin and end.
BREAK = "[\n.!?]"
_SPACE = r"[\s\x{FEFF}]"


def byte_view(body: Column) -> Column:
    """A string with one character (0 to 255) for each byte of a binary column, so that string functions count bytes."""
    return F.decode(body, "ISO-8859-1")


def utf8_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column) -> Column:
    """The tokens of a text in order, in lower case, with repetitions."""
    return F.regexp_extract_all(lower_ascii(byte_view(utf8_bytes(text))), F.lit(TOKEN), F.lit(0))


def as_text(body: Column) -> Column:
    """Bytes as text: UTF-8 if they are valid UTF-8, else Latin-1."""
    plain = body.cast("string")
    return F.when(F.is_valid_utf8(plain), plain).otherwise(byte_view(body))


def trimmed(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapsed(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return trimmed(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def without_markup(xml: Column) -> Column:
    """The text of an XML document: without embedded binary data, long base64 runs and tags."""
    out = F.regexp_replace(xml, r"(?s)<w:binData[^>]*>.*?</w:binData>", "")
    # the ends of a run are ASCII word boundaries: a word character on just one side
    left, right = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9_])(?=[+/]))", r"(?:(?<=[A-Za-z0-9])(?![A-Za-z0-9_])|(?<=[+/=])(?=[A-Za-z0-9_]))"
    out = F.regexp_replace(out, rf"{left}[A-Za-z0-9+/]{{120,}}={{0,2}}{right}", " ")
    return collapsed(F.regexp_replace(out, "<[^>]+>", " "))


def file_type(body: Column) -> Column:
    """pdf, docx, json, markdown, text, or unknown (under four bytes), from the first bytes alone."""
    head = F.hex(F.substring(body, 1, 4))
    first = F.substring(F.ltrim(byte_view(body), F.lit(" \n\r\t")), 1, 1)
    return (
        F.when(F.octet_length(body) < 4, "unknown")
        .when(head == "25504446", "pdf")
        .when(head == "504B0304", "docx")
        .when(first.isin("{", "["), "json")
        .when(F.substring(head, 1, 4) == "2320", "markdown")
        .otherwise("text")
    )


def snippet(body: Column, offset: Column, window: int) -> Column:
    """The text around a byte offset: about `window` bytes on either side, from one sentence or line end to another."""
    if window < 0:
        raise ValueError("window must not be negative")
    view, n = byte_view(body), F.octet_length(body)

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(x, n)).cast("int")

    low, high, here = clamp(offset - window), clamp(offset + window), clamp(offset)
    before = F.length(F.regexp_extract(F.substring(view, F.lit(1), low), rf"(?s)^.*{BREAK}", 0))
    inside = F.regexp_instr(F.substring(view, low + 1, here - low), F.lit(BREAK))
    start = F.when(before > 0, before).when(inside > 0, low + inside).otherwise(0).cast("int")
    after = F.regexp_instr(F.substring(view, high + 1, n - high), F.lit(BREAK))
    end = F.when(after > 0, high + after).otherwise(n).cast("int")
    cut = F.substring(body, start + 1, F.greatest(end - start, F.lit(0)))
    return trimmed(F.make_valid_utf8(cut.cast("string")))


def hits(text: Column, term: Column) -> Column:
    """The starts, from 0, of the non-overlapping places of a lower-case term in a text, whatever their case."""
    parts = F.split(F.lower(text), F.concat(F.lit(r"\Q"), term, F.lit(r"\E")), -1)
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, x: acc + F.length(x))
    found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: before(i) + (i - 1) * F.length(term))
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<int>"))


def match_ranges(text: Column, terms: Column) -> Column:
    """Of an array of terms (repetitions kept): array<struct<start, end, term>>, by start, then by the terms' order."""
    of_term = lambda t, i: F.transform(hits(text, t), lambda s: F.struct(s.alias("start"), i.alias("nth"), (s + F.length(t)).alias("end"), t.alias("term")))
    every = F.array_sort(F.flatten(F.transform(terms, of_term)))
    return F.transform(every, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["term"].alias("term")))


def matched_terms(ranges: Column) -> Column:
    """The terms that occur, in the order of their first places."""
    return F.array_distinct(F.transform(ranges, lambda r: r["term"]))


def valid_ranges(ranges: Column) -> Column:
    """The ranges that start at 0 or later and end after their start."""
    return F.filter(ranges, lambda r: r["start"].isNotNull() & r["end"].isNotNull() & (r["start"] >= 0) & (r["end"] > r["start"]))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once, however often it stands in it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged_ranges(ranges: Column) -> Column:
    """Ranges (start, end) by start, those that overlap or touch made one.

    With starts and ends sorted by themselves there is a gap before the i-th start just if as many ranges have ended below
    it as have begun, so that one look at each range is enough."""
    valid = valid_ranges(ranges)
    starts, ends = F.array_sort(F.transform(valid, lambda r: r["start"].cast("int"))), F.array_sort(F.transform(valid, lambda r: r["end"].cast("int")))

    def islands(both: Column) -> Column:
        first = F.filter(both["s"], lambda x, i: (i == 0) | (x > F.get(both["e"], i - 1)))
        last = F.filter(both["e"], lambda x, i: (i == F.size(both["e"]) - 1) | (F.get(both["s"], i + 1) > x))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    return _with(F.struct(starts.alias("s"), ends.alias("e")), islands)


def highlight_terms(query: Column) -> Column:
    """A query's distinct words by white space, in lower case: what to mark where no match ranges are known."""
    return F.filter(F.array_distinct(F.split(F.lower(query), r"\s+")), lambda t: t != "")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _every_place(low: pd.Series, terms: pd.Series) -> pd.Series:
    def places(text: str | None, words: Sequence[str] | None) -> list[dict[str, int]] | None:
        if text is None or words is None:
            return None
        found = []
        for w in words:
            at = text.find(w) if w else -1
            while at >= 0:
                found.append({"start": at, "end": at + len(w)})
                at = text.find(w, at + 1)
        return found

    return pd.Series([places(t, w) for t, w in zip(low, terms, strict=True)], dtype=object)


def fallback_ranges(text: Column, terms: Column) -> Column:
    """Of an array of lower-case terms all places in a text, whatever their case and overlapping ones included, those that
    overlap or touch made one: what to mark where no match ranges are known. A text is walked once a term."""
    return merged_ranges(_every_place(F.lower(text), terms))


def overlapping_count(text: Column, pattern: str, *, ignore_case: bool = False) -> Column:
    """How often a literal occurs, overlapping places included; ignore_case: of ASCII letters."""
    if not pattern:
        return F.lit(0)
    quoted = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    return F.regexp_count(text, F.lit(("(?i)" if ignore_case else "") + f"(?={quoted})"))


def plain_snippet(text: Column) -> Column:
    """Without ANSI colours and double asterisks."""
    return F.regexp_replace(F.regexp_replace(text, r"\x1B\[[0-9;]*m", ""), r"\*\*", "")


def title(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_label(path: Column) -> Column:
    """The extension of a path in upper case, or "No ext"."""
    ext = F.upper(F.regexp_extract(title(path), r"^.+\.([^.]+)$", 1))
    return F.when(ext == "", "No ext").otherwise(ext)


def preview_fraction(offset: Column, body: Column) -> Column:
    """How far into the bytes an offset lies, 0 to 1; 0 in an empty body."""
    n = F.octet_length(body)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), offset / n)))


def size_label(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    out = F.format_string("%.1f B", n.cast("double"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def count_label(n: Column) -> Column:
    """A number with K or M from a thousand and a million on."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("long").cast("string"))


def age_label(then: Column, now: Column) -> Column:
    """How long ago, in days, hours or minutes."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    whole = lambda unit: F.floor(s / unit).cast("string")
    return F.when(s >= 86400, F.concat(whole(86400), F.lit("d ago"))).when(s >= 3600, F.concat(whole(3600), F.lit("h ago"))).when(s >= 60, F.concat(whole(60), F.lit("m ago"))).otherwise("Just now")

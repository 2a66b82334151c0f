import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fn


def value(spark, column, **columns):
    kinds = {str: "string", bytes: "binary", int: "int", list: "array<string>"}
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Hello, WORLD 42", ["hello", "world", "42"]), ("blåbær", ["bl", "b", "r"]), ("", []), ("é!", []), ("a_b-c\n\0d", ["a", "b", "c", "d"])],
)
def test_tokens(spark, text, expected):
    assert value(spark, fn.tokens(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    ("body", "kind"),
    [(b"ab", "unknown"), (b"%PDF-1.4", "pdf"), (b"PK\x03\x04rest", "docx"), (b" \n\t{1}", "json"), (b"[1, 2]", "json"), (b"# head", "markdown"), (b"#head", "text"), (b"    ", "text"), (b"\xff\xfe{a", "text")],
)
def test_file_type(spark, body, kind):
    assert value(spark, fn.file_type(F.col("b")), b=body) == kind


def test_as_text(spark):
    assert value(spark, fn.as_text(F.col("b")), b=b"A \xe5") == "A å"
    assert value(spark, fn.as_text(F.col("b")), b="A å".encode()) == "A å"


def test_without_markup(spark):
    run = "A" * 200
    assert value(spark, fn.without_markup(F.col("x")), x=f"<w:t>one</w:t> {run} <w:binData w:n='1'>\nAAAA</w:binData><p>word  two</p>") == "one word two"
    assert run in value(spark, fn.without_markup(F.col("x")), x=f"<p>é_{run}_</p>")


CASES = [
    ("FIRST_PARAGRAPH_MARKER has unrelated details.\n\nmatch appears in second paragraph with useful context.", 30, "match appears in second paragraph with useful context."),
    ("HEADER_LINE_MARKER\nmatch appears on second line with context", 25, "match appears on second line with context"),
    ("HEADER_LINE_MARKER\r\nmatch appears after CRLF boundary", 24, "match appears after CRLF boundary"),
    ("tiny match doc", 5000, "tiny match doc"),
    ("Sentence one is here. The match is in this one! And a third follows it.", 12, "The match is in this one!"),
]


@pytest.mark.parametrize(("text", "window", "expected"), CASES)
def test_snippet(spark, text, window, expected):
    at = len(text[: text.index("match")].encode())
    assert value(spark, fn.snippet(F.col("b"), F.col("m"), window), b=text.encode(), m=at) == expected


def slow_snippet(body, m, w):
    marks = b"\n.!?"
    low, high, here = (max(0, min(x, len(body))) for x in (m - w, m + w, m))
    start = next((i + 1 for i in reversed(range(low)) if body[i] in marks), None)
    if start is None:
        start = next((i + 1 for i in range(low, here) if body[i] in marks), 0)
    end = next((i + 1 for i in range(high, len(body)) if body[i] in marks), len(body))
    return re.sub(r"^[\s﻿]+|[\s﻿]+$", "", body[start : max(end, start)].decode(errors="replace"))


def test_snippet_equals_a_scan(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice("ab é€.\n! ") for _ in range(rng.randint(0, 40))).encode(), rng.randint(0, 45), w) for w in (0, 3, 9) for _ in range(150)]
    for w in (0, 3, 9):
        part = [(bytearray(b), m) for b, m, x in rows if x == w]
        got = [r["s"] for r in spark.createDataFrame(part, "b binary, m int").select(fn.snippet(F.col("b"), F.col("m"), w).alias("s")).collect()]
        whole = [(g, slow_snippet(bytes(b), m, w)) for g, (b, m) in zip(got, part, strict=True)]
        assert all(g == s for g, s in whole if "�" not in s)  # how many marks stand for a cut character is not fixed


def test_ranges(spark):
    ranges = fn.match_ranges(F.col("t"), F.col("terms"))
    found = value(spark, ranges, t="TEST Test testest", terms=["test", "es", "[x]"])
    assert [(r["start"], r["end"], r["term"]) for r in found] == [(0, 4, "test"), (1, 3, "es"), (5, 9, "test"), (6, 8, "es"), (10, 14, "test"), (11, 13, "es"), (14, 16, "es")]
    assert value(spark, fn.matched_terms(ranges), t="es test", terms=["test", "es"]) == ["es", "test"]
    assert [(r["start"], r["end"]) for r in value(spark, fn.merged_ranges(ranges), t="TEST Test testest", terms=["test", "es"])] == [(0, 4), (5, 9), (10, 16)]
    assert value(spark, fn.merged_ranges(ranges), t="nothing", terms=["xyz"]) == []
    assert value(spark, ranges, t="", terms=["a"]) == []


def test_overlapping_count(spark):
    assert value(spark, fn.overlapping_count(F.col("t"), "aa"), t="aaaa AA") == 3
    assert value(spark, fn.overlapping_count(F.col("t"), "aa", ignore_case=True), t="aaaa AA") == 4
    assert value(spark, fn.overlapping_count(F.col("t"), r"a\E."), t=r"xa\E.a\Eb") == 1
    assert value(spark, fn.overlapping_count(F.col("t"), ""), t="abc") == 0


def test_labels(spark):
    assert [value(spark, fn.extension_label(F.col("p")), p=p) for p in ("a/b.TXT", "a.b/c", "x.tar.gz", ".hidden")] == ["TXT", "No ext", "GZ", "No ext"]
    assert [value(spark, fn.size_label(F.col("n")), n=n) for n in (0, 1023, 1536, 5 << 20)] == ["0.0 B", "1023.0 B", "1.5 KB", "5.0 MB"]
    assert [value(spark, fn.count_label(F.col("n")), n=n) for n in (999, 1000, 2_500_000)] == ["999", "1.0K", "2.5M"]
    assert value(spark, fn.plain_snippet(F.col("t")), t="\x1b[31mred\x1b[0m **bold**") == "red bold"
    assert value(spark, fn.highlight_terms(F.col("t")), t=" The  the cat") == ["the", "cat"]

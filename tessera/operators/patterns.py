"""Counting literals and JSON levels, and marking terms, over whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as fn

from . import automaton

#: Places of terms that are handed on together, those of one text at least.
PLACES = 1 << 18
_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_LEVEL = r'"level":[^"]*"([^"]*)"'


def _sums(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """label and n: the sum of each column over all rows, 0 if there are none."""
    one = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(counts.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"c{i}").alias("n")) for i, k in enumerate(counts)])).alias("x")).select("x.label", "x.n")


def pattern_counts(docs: DataFrame, patterns: Sequence[str], *, ignore_case: bool = False) -> DataFrame:
    """label and n: how often each literal occurs in the bytes of all documents (doc_id, body), overlapping places
    included; those that never occur have 0. ignore_case: of ASCII letters. One pass over the table, whatever the number
    of literals, counts combined before the shuffle."""
    view = fn.byte_view(F.col("body"))
    return _pattern_counts(docs.select((fn.lower_ascii(view) if ignore_case else view).alias("text")), patterns, ignore_case)


def _pattern_counts(texts: DataFrame, patterns: Sequence[str], ignore_case: bool, **how) -> DataFrame:
    """`pattern_counts` of texts as `automaton.counts` takes them: a character for each byte, in lower case if case is ignored."""
    if not patterns:
        raise ValueError("no patterns")
    labels = list(dict.fromkeys(patterns))
    folded = [_bytes_in(p, ignore_case) for p in labels]
    literals = [p for p in dict.fromkeys(folded) if p]
    found = automaton.counts(texts, literals, **how)
    place = {p: i for i, p in enumerate(literals)}
    asked = texts.sparkSession.createDataFrame([(label, place.get(p)) for label, p in zip(labels, folded, strict=True)], "label string, nth long")
    return asked.join(found, "nth", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _bytes_in(pattern: str, ignore_case: bool) -> str:
    """A literal's bytes as characters, as in `byte_view`."""
    view = pattern.encode().decode("latin-1")
    return "".join(c.lower() if c.isascii() else c for c in view) if ignore_case else view


def level_counts(docs: DataFrame) -> DataFrame:
    """label and n: the first quoted string after each "level": in the documents, without parsing JSON."""
    found = F.regexp_extract_all(fn.byte_view(F.col("body")), F.lit(_LEVEL), F.lit(1))
    return docs.select(F.explode(found).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(fn.as_text(F.encode("label", "ISO-8859-1")).alias("label"), "n")


def compressed_streams(docs: DataFrame) -> DataFrame:
    """label (compressedStreams) and n: how often /Filter occurs in the PDF documents."""
    return _sums(docs.where(fn.file_type(F.col("body")) == "pdf"), {"compressedStreams": F.regexp_count(fn.byte_view(F.col("body")), F.lit("/Filter"))})


def counts_by_type(files: DataFrame, patterns: Sequence[str] = (), *, ignore_case: bool = False) -> DataFrame:
    """label and n over files (path, content) as their types ask for: PDFs by compressed streams, the inner document of
    DOCX files and all others by patterns, or by levels where no patterns are given. DOCX files are read where patterns are
    counted, one after the other, so that a task has no more than one Python worker, and the reading process, for both."""
    from tessera.sources.extract import main_parts

    rows = files.select(F.col("content").alias("body"), fn.file_type(F.col("content")).alias("kind"))
    out = compressed_streams(rows)
    if patterns:

        def read(batches: Iterable[pa.RecordBatch]) -> Iterator[str]:
            for data in main_parts(batches):
                yield ((data or b"").lower() if ignore_case else data or b"").decode("latin-1")

        both = _pattern_counts(rows.where("kind <> 'pdf'").select("kind", F.col("body").cast("binary")), patterns, ignore_case, read=read)
    else:
        both = level_counts(rows.where("kind not in ('docx', 'pdf')").select("body"))
    return out.union(both).groupBy("label").agg(F.sum("n").alias("n"))


def merged_matches(rows: DataFrame, keys: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """The keys of each row and merged: the places of lower-case terms, whatever their case, in its whole text, as
    array<struct<start, end>>, those that overlap or touch made one. Each text is walked once a term where it stands; nothing is
    shuffled, so that a task holds no more than a batch of texts and the places in some of them."""
    if not terms or "" in terms:
        raise ValueError("no terms")
    texts = rows.select(*keys, F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("merged", _RANGES)])
    names, wanted, kind = [*keys, "merged"], list(terms), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: pa.RecordBatch, first: int, found: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate(found)
            at = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["start", "end"]))
            return pa.record_batch([*(b.column(c).slice(first, len(found)) for c in range(len(keys))), lists.cast(kind)], names=names)

        for b in batches:
            first, found, size = 0, [], 0
            for i, text in enumerate(b.column(len(keys))):
                found.append(_islands(text.as_py(), wanted))
                size += len(found[-1])
                if size >= PLACES:
                    yield made(b, first, found)
                    first, found, size = i + 1, [], 0
            if found:
                yield made(b, first, found)

    return texts.mapInArrow(run, schema)


def _islands(text: str, terms: Sequence[str]) -> np.ndarray:
    """Starts and ends of the places of terms, of each those that don't overlap with an earlier one, merged."""
    places: list[tuple[int, int]] = []
    for t in terms:
        size = len(t)
        at = text.find(t)
        while at >= 0:
            places.append((at, at + size))
            at = text.find(t, at + size)
    if not places:
        return np.zeros((0, 2), np.int32)
    both = np.array(places, np.int32)
    starts, ends = np.sort(both[:, 0]), np.sort(both[:, 1])
    # with starts and ends sorted by themselves there is a gap before a start just if as many have ended below it as have begun
    gap = starts[1:] > ends[:-1]
    return np.stack([starts[np.r_[True, gap]], ends[np.r_[gap, True]]], axis=1)

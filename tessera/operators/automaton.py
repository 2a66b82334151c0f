"""Many literals in one pass: an automaton (goto, failure and output links) of all of them walks each text once, so that the
time hardly depends on how many there are. Batches of texts go through it in Arrow; the automaton is made in each task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals of one automaton; of more, several walk the texts one after the other.
LITERALS = 200_000


def made(literals: Sequence[str]) -> ahocorasick.Automaton:
    """Of different literals, none empty: what it finds are their places in the sequence."""
    found = ahocorasick.Automaton()
    for i, x in enumerate(literals):
        found.add_word(x, i)
    found.make_automaton()
    return found


def bytes_before(text: str, places: list[int]) -> list[int]:
    """The bytes of a text before some of its characters."""
    if text.isascii():
        return [min(p, len(text)) for p in places]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]
    return before[np.minimum(places, len(code))].tolist()


def _strings(batches: Iterable[pa.RecordBatch]) -> Iterator[str | None]:
    for b in batches:
        for t in b.column(0):
            yield t.as_py()


def counts(texts: DataFrame, literals: Sequence[str], read: Callable[[Iterable[pa.RecordBatch]], Iterable[str | None]] = _strings) -> DataFrame:
    """nth (of the literals) and n: how often it occurs in all texts, overlapping places included; those that never occur
    have no row. Counted in the tasks, then added up. read: the texts of batches of the table, one after the other; by itself
    those of its first column."""
    if not literals:
        return texts.sparkSession.createDataFrame([], "nth long, n long")
    sent = texts.sparkSession.sparkContext.broadcast(list(literals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = made(sent.value)
        n = [0] * len(sent.value)
        for text in read(batches):
            for _, i in walk.iter(text or ""):
                n[i] += 1
        some = [i for i, x in enumerate(n) if x]
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array([n[i] for i in some], pa.int64())], names=["nth", "n"])

    return texts.mapInArrow(run, "nth long, n long").groupBy("nth").agg(F.sum("n").alias("n"))


def occurrences(texts: DataFrame, literals: DataFrame, *, low: Column) -> DataFrame:
    """doc_id, term, n and first: the places of each of the literals (term, different ones) in each text (doc_id, text) that
    don't overlap with an earlier one of the same, counted from the left, and the bytes of the text (in UTF-8) before the first.

    low: the text in which they are looked for, with a character for each one of `text`. Literals come to the driver LITERALS at a
    time, to be sent to the tasks; each such block is one pass over the texts."""
    spark = texts.sparkSession
    blocks = max(1, -(-literals.count() // LITERALS))
    rows = texts.select("doc_id", low.alias("low"), "text")
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, term string, n long, first long"
    out = None
    for block in range(blocks):
        mine = literals.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).select("term")
        sent = spark.sparkContext.broadcast(sorted(r["term"] for r in mine.toLocalIterator()))

        def run(batches, sent=sent):
            terms = sent.value
            walk, sizes = made(terms), [len(t) for t in terms]
            for b in batches:
                ids: list[int] = []
                of: list[int] = []
                n: list[int] = []
                first: list[int] = []
                for at, (t, own) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                    begin = len(first)
                    known: dict[int, int] = {}  # places in the lists
                    free: dict[int, int] = {}  # where the next one may begin
                    for end, i in walk.iter(t.as_py() or "") if terms else ():
                        start = end + 1 - sizes[i]
                        if i not in known:
                            known[i] = len(of)
                            ids.append(at)
                            of.append(i)
                            n.append(1)
                            first.append(start)
                        elif start >= free[i]:
                            n[known[i]] += 1
                        else:
                            continue
                        free[i] = end + 1
                    if len(first) > begin:
                        first[begin:] = bytes_before(own.as_py(), first[begin:])
                names = pa.array(terms, pa.string()).take(pa.array(of, pa.int64()))
                yield pa.record_batch([b.column(0).take(pa.array(ids, pa.int64())), names, pa.array(n, pa.int64()), pa.array(first, pa.int64())], names=["doc_id", "term", "n", "first"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out

"""The best documents of many queries by substrings, without an index: scores are summed where the texts are, so that no rows of
documents and queries are shuffled but those that can be among the best.

Query terms are runs of ASCII letters and digits, so that all their places lie within such runs of the text. Each different run goes through
the automaton once in a while; a text's counts follow from its runs', and its scores from the counts, some hundred texts at once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.slices import cuts

from . import automaton

#: Numbers that are held for a slice of texts, about: of each text, one for each term and each query.
NUMBERS = 1 << 21
#: Runs, and bytes of them, that a task remembers with their terms.
RUNS, RUN_BYTES = 1 << 18, 32 << 20
_ELSE_BLANK = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))


class Runs(dict):
    """The numbers of runs; what terms a run holds, and how often apart from each other, is found when it is first asked for."""

    def __init__(self, terms: Sequence[str]) -> None:
        super().__init__()
        self.walk, self.sizes = automaton.made(terms), [len(t) for t in terms]
        self.term, self.n, self.end = array("q"), array("q"), array("q", [0])
        self.bytes = 0

    def __missing__(self, run: bytes) -> int:
        found: dict[int, int] = {}
        free: dict[int, int] = {}  # where the next place of a term may begin
        for end, i in self.walk.iter(run.decode()):
            if end + 1 - self.sizes[i] >= free.get(i, 0):
                found[i] = found.get(i, 0) + 1
                free[i] = end + 1
        self.term.extend(found)
        self.n.extend(found.values())
        self.end.append(len(self.term))
        self.bytes += len(run)
        self[run] = number = len(self)
        return number

    def forget(self) -> None:
        self.clear()
        self.term, self.n, self.end, self.bytes = array("q"), array("q"), array("q", [0]), 0


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, so many of each."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _added(place: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(place, value, shape[0] * shape[1]).reshape(shape)  # whole numbers below 2 ** 53


def best(texts: DataFrame, asked: list, query_type: T.DataType, k: int) -> DataFrame:
    """query_id, doc_id, score and match_offset of the documents that can be among the k best of each query, k of each
    task: those with the highest scores (occurrences of all terms), equal ones by doc_id.

    texts: doc_id (different whole numbers or strings), low (the text in lower case) and text. asked: rows of query_id, term, times,
    terms of [a-z0-9] only."""
    spark = texts.sparkSession
    terms = sorted({r["term"] for r in asked})
    code = {t: i for i, t in enumerate(terms)}
    ids = list(dict.fromkeys(r["query_id"] for r in asked))
    number = {q: i for i, q in enumerate(ids)}
    rows = sorted((code[r["term"]], number[r["query_id"]], r["times"]) for r in asked)
    of, query, times = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    sent = spark.sparkContext.broadcast((terms, len(ids), np.searchsorted(of, np.arange(len(terms) + 1)), query, times))
    schema = T.StructType([T.StructField("nth", T.LongType()), texts.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("match_offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n_queries, cut, query, times = sent.value
        runs = Runs(terms)
        words_of = [[] for _ in range(n_queries)]
        for i, t in enumerate(terms):
            for q in query[cut[i] : cut[i + 1]].tolist():
                words_of[q].append(t)
        kept: list[list[tuple]] = [[] for _ in range(n_queries)]  # -score, order of doc_id, offset
        reached = np.zeros(n_queries)

        def scores(lows: pa.Array) -> np.ndarray:
            found = [np.fromiter(map(runs.__getitem__, t.as_buffer().to_pybytes().translate(_ELSE_BLANK).split() if t.is_valid else ()), np.int64) for t in lows]
            doc, word = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
            term, n, end = (np.frombuffer(x, np.int64) for x in (runs.term, runs.n, runs.end))
            many = end[word + 1] - end[word]
            at = _spread(end[word], many)
            counts = _added(np.repeat(doc, many) * len(terms) + term[at], n[at], (len(found), len(terms)))
            doc, term = np.nonzero(counts)
            many = cut[term + 1] - cut[term]
            at = _spread(cut[term], many)
            return _added(np.repeat(doc, many) * n_queries + query[at], np.repeat(counts[doc, term], many) * times[at], (len(found), n_queries))

        def look(keys: list, lows: pa.Array, texts: pa.Array) -> None:
            total = scores(lows)
            order = [(key is not None, key) for key in keys]  # nulls first, as Spark sorts them
            by_key = np.array(sorted(range(len(keys)), key=order.__getitem__))
            total = total[by_key]
            can = (total > 0) & (total >= reached)
            for q in np.flatnonzero(can.any(axis=0)).tolist():
                rows = np.flatnonzero(can[:, q])
                rows = rows[np.argsort(-total[rows, q], kind="stable")[:k]]
                new = [(-float(total[r, q]), order[by_key[r]], None, int(by_key[r])) for r in rows]
                merged = sorted([*kept[q], *new])[:k]
                kept[q] = [x[:3] if x[2] is not None else (x[0], x[1], first(lows[x[3]].as_py(), texts[x[3]].as_py(), words_of[q])) for x in merged]
                if len(merged) == k:
                    reached[q] = -merged[-1][0]

        def first(low: str, text: str, words: list[str]) -> int:
            return automaton.bytes_before(text, [min(p for w in words if (p := low.find(w)) >= 0)])[0]

        most = max(1, NUMBERS // max(len(terms), n_queries))
        for b in batches:
            for i, j in cuts(b.column(1)):
                for a in range(i, j, most):
                    some = b.slice(a, min(most, j - a))
                    if some.num_rows:
                        look(some.column(0).to_pylist(), some.column(1), some.column(2))
                    if len(runs) > RUNS or runs.bytes > RUN_BYTES:
                        runs.forget()
        flat = [(q, x[1][1], -x[0], x[2]) for q, own in enumerate(kept) for x in own]
        columns = list(zip(*flat, strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], b_type), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())], names=["nth", "doc_id", "score", "match_offset"])

    b_type = _ARROW[type(texts.schema["doc_id"].dataType)]
    found = texts.select("doc_id", "low", "text").mapInArrow(run, schema)
    back = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("nth", T.LongType()), T.StructField("query_id", query_type)]))
    return found.join(F.broadcast(back), "nth").select("query_id", "doc_id", "score", "match_offset")


_ARROW = {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.StringType: pa.string()}


def can_order(doc_id: T.DataType) -> bool:
    """Whether Python orders such doc_ids as Spark does."""
    return doc_id == T.StringType() if isinstance(doc_id, T.StringType) else type(doc_id) in _ARROW

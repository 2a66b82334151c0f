"""Many queries at once: postings are dealt out by their documents once, however many queries ask for their terms, and a document's
scores for all queries are summed where its postings lie.

Blocks of the queries' terms are unpacked and their postings dealt out by doc_id, many in a row of packed numbers. A task then
has all postings of some thousand documents, and adds up each query's terms in the order of the query, as a sum of single rows would.
Of each query it hands on the documents that can be among its k best, equal ones at the cut included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed

#: Terms of all queries, repeated ones included, that are sent to the tasks; more are scored row by row.
WEIGHTS = 1_000_000
#: Documents that are scored together, about.
DOCUMENTS = 8_000
#: Postings that are dealt out together.
DEALT = 1 << 19

_COLUMNS = {"code": np.int32, "block": np.int64, "doc": np.int64, "tf": np.int32, "length": np.int32}
_PARTS = pa.list_(pa.struct([("qi", pa.int32()), ("part", pa.float64()), ("term", pa.string()), ("block", pa.int64())]))


def _bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """Documents dealt out evenly, whatever their numbers have in common."""
    mixed = doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _dealt(blocks: DataFrame, codes: dict[str, int], n: int) -> DataFrame:
    """bucket and the postings of its documents, some in a row."""
    sent = blocks.sparkSession.sparkContext.broadcast(codes)
    schema = "bucket long, " + ", ".join(f"{c} binary" for c in _COLUMNS)

    def rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        bucket = _bucket(columns[2], n)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        made = [packed._binaries(np.ascontiguousarray(c[order].astype(t)).view(np.uint8), cut * t().itemsize) for c, t in zip(columns, _COLUMNS.values(), strict=True)]
        return pa.record_batch([pa.array(bucket[cut[:-1]]), *made], names=["bucket", *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            for i in range(0, b.num_rows, packed.TOGETHER // packed.BLOCK):
                some = b.slice(i, packed.TOGETHER // packed.BLOCK)
                code = np.array([sent.value.get(t, -1) for t in some.column("term").to_pylist()], np.int64)
                block = np.asarray(some.column("block"))
                for row, doc, tf, length, _ in packed._unpacked(some, False):
                    mine = code[row] >= 0
                    parts.append((code[row][mine], block[row][mine], doc[mine], tf[mine], length[mine]))
                    size += int(mine.sum())
                if size >= DEALT:
                    yield rows(parts)
                    parts, size = [], 0
        if size:
            yield rows(parts)

    return blocks.select("term", "block", "n", "first_doc", "bits", "docs", "counts").mapInArrow(run, schema)


def best(blocks: DataFrame, weights: DataFrame, k: int, n_docs: int, part) -> DataFrame:
    """query_id, doc_id and parts (array of qi, part, term and block, by qi) of the documents that can be among the k best of each
    query by the sum of their parts. blocks: of the queries' terms. weights: query_id, qi, term, idf, WEIGHTS rows at most.
    part: the score of postings by arrays of tf, tokens and idf; positive."""
    spark = blocks.sparkSession
    asked = weights.collect()
    names = sorted({r["term"] for r in asked})
    codes = {t: i for i, t in enumerate(names)}
    ids = list(dict.fromkeys(r["query_id"] for r in asked))
    number = {q: i for i, q in enumerate(ids)}
    idf = np.zeros(len(names))
    of: list[list[tuple[int, int]]] = [[] for _ in ids]
    for r in asked:
        idf[codes[r["term"]]] = r["idf"]
        of[number[r["query_id"]]].append((r["qi"], codes[r["term"]]))
    n = 1 + n_docs // DOCUMENTS
    sent = spark.sparkContext.broadcast(([sorted(x) for x in of], idf, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idf, names = sent.value
        reached = np.zeros(len(queries))  # by k documents of one bucket of this task

        def scored(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            code, block, doc, tf, length = (np.concatenate(x) for x in zip(*rows, strict=True))
            docs, place = np.unique(doc, return_inverse=True)
            order = np.lexsort((place, code))
            code, block, place = code[order], block[order], place[order]
            score = part(tf[order], length[order], idf[code])
            cut = np.searchsorted(code, np.arange(len(names) + 1))
            out: dict[str, list[np.ndarray]] = {x: [] for x in ("query", "doc", "n", "qi", "part", "code", "block")}
            for q, terms in enumerate(queries):
                total = np.zeros(len(docs))
                for _, c in terms:
                    i, j = cut[c], cut[c + 1]
                    total[place[i:j]] += score[i:j]
                found = np.flatnonzero(total)
                if len(found) >= k:
                    reached[q] = max(reached[q], np.partition(total[found], -k)[-k])
                found = found[total[found] >= reached[q]]
                if not len(found):
                    continue
                at = np.empty((len(found), len(terms)), np.int64)
                there = np.zeros(at.shape, bool)
                for t, (_, c) in enumerate(terms):
                    i, j = cut[c], cut[c + 1]
                    if i < j:
                        at[:, t] = np.minimum(np.searchsorted(place[i:j], found) + i, j - 1)
                        there[:, t] = place[at[:, t]] == found
                own = at[there]
                out["query"].append(np.full(len(found), q))
                out["doc"].append(docs[found])
                out["n"].append(there.sum(axis=1))
                out["qi"].append(np.broadcast_to([qi for qi, _ in terms], at.shape)[there])
                out["part"].append(score[own])
                out["code"].append(code[own])
                out["block"].append(block[own])
            if not out["doc"]:
                return pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], _PARTS)], names=["nth", "doc_id", "parts"])
            flat = {x: np.concatenate(v) for x, v in out.items()}
            structs = pa.StructArray.from_arrays([pa.array(flat["qi"].astype(np.int32)), pa.array(flat["part"]), pa.array(names, pa.string()).take(pa.array(flat["code"])), pa.array(flat["block"])], ["qi", "part", "term", "block"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(flat["n"])].astype(np.int32)), structs)
            return pa.record_batch([pa.array(flat["query"]), pa.array(flat["doc"]), lists], names=["nth", "doc_id", "parts"])

        bucket, rows = None, []
        for b in batches:
            for i, own in enumerate(b.column(0).to_pylist()):
                if own != bucket and rows:
                    yield scored(rows)
                    rows = []
                bucket = own
                rows.append([np.frombuffer(b.column(1 + c)[i].as_py(), t) for c, t in enumerate(_COLUMNS.values())])
        if rows:
            yield scored(rows)

    placed = _dealt(blocks, codes, n).repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket")
    found = placed.mapInArrow(run, "nth long, doc_id long, parts array<struct<qi:int,part:double,term:string,block:long>>")
    schema = T.StructType([T.StructField("nth", T.LongType()), weights.schema["query_id"]])
    back = spark.createDataFrame([(i, q) for i, q in enumerate(ids)], schema)
    return found.join(F.broadcast(back), "nth").select("query_id", "doc_id", "parts")

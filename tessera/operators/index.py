"""The inverted index: postings, document and corpus statistics, as tables.

A batch of documents is tokenised as a whole in numpy: its bytes lie one after the other, so that tokens, their offsets and
their documents are arrays, and strings are cut from the bytes without a Python object for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as fn

from . import packed

#: Offsets that a posting keeps, the first ones; its tf counts all.
MAX_OFFSETS = 128
#: Bytes of bodies that are tokenised together, one document at least.
BATCH_BYTES = 4 << 20
#: Bytes of a row group of packed postings: what a lookup reads at least.
ROW_GROUP = 8 << 20
#: Bytes of packed postings, as written, of a partition that is sorted.
PART_BYTES = 32 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TOKEN = np.isin(_LOWER, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, and the bytes and places of their bodies (null: empty), some megabytes at a time."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
    part = (np.cumsum(size) - size) // BATCH_BYTES
    cuts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]).tolist(), len(part)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.column(0).slice(i, j - i), *packed.bytes_of(batch.column(1).slice(i, j - i).fill_null(b""))


def _found(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every token its document, its offset there, and the token in lower case."""
    within = _IN_TOKEN[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    start = np.flatnonzero(within & (np.r_[True, ~within[:-1]][: len(raw)] | first[:-1]))
    end = np.flatnonzero(within & (np.r_[~within[1:], True][: len(raw)] | first[1:])) + 1
    doc = np.searchsorted(at, start, "right") - 1
    size = end - start
    cut = np.r_[0, np.cumsum(size)]
    letters = _LOWER[raw[np.arange(cut[-1]) + np.repeat(start - cut[:-1], size)]]
    terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(letters))
    return doc, start - at[doc], terms


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, term and off (in bytes) of every token of every document (doc_id, body), in order within a document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("term", T.StringType()), T.StructField("off", T.LongType())])

    def run(batches):
        for b in batches:
            for ids, raw, at in _slices(b):
                doc, off, terms = _found(raw, at)
                yield pa.record_batch([ids.take(pa.array(doc)), terms, pa.array(off)], names=schema.names)

    return docs.select("doc_id", "body").mapInArrow(run, schema)


def _grouped(raw: np.ndarray, at: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Offsets in the order of documents and terms; where each pair of them begins (and the end), its document, its term,
    and the tokens of each document. places: offsets in tokens in place of bytes."""
    doc, off, terms = _found(raw, at)
    if places:
        off = np.arange(len(doc)) - np.searchsorted(doc, doc)
    coded = terms.dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    key = doc * max(1, len(coded.dictionary)) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)]), len(key)]
    one = order[cut[:-1]]
    return off[order], cut, doc[one], coded.dictionary.take(pa.array(code[one])), np.bincount(doc, minlength=len(at) - 1)


def postings(docs: DataFrame, max_offsets: int = MAX_OFFSETS, *, places: bool = False) -> DataFrame:
    """term, doc_id, tf, token_count (of the document) and offsets (the first max_offsets, in bytes; places: in tokens) of every
    term of every document (doc_id, body). A document's tokens are all in its own row, so that nothing is shuffled."""
    columns = [T.StructField("tf", T.LongType()), T.StructField("token_count", T.LongType()), T.StructField("offsets", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("term", T.StringType()), docs.schema["doc_id"], *columns])
    return docs.select("doc_id", "body").mapInArrow(lambda batches: _postings(batches, max_offsets, places), schema)


def _postings(batches: Iterator[pa.RecordBatch], max_offsets: int, places: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, raw, at in _slices(b):
            off, cut, doc, terms, counts = _grouped(raw, at, places)
            tf = np.diff(cut)
            kept = np.minimum(tf, max_offsets)
            if (kept < tf).any():
                off = off[np.arange(len(off)) - np.repeat(cut[:-1], tf) < max_offsets]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), pa.array(off))
            yield pa.record_batch([terms, ids.take(pa.array(doc)), pa.array(tf), pa.array(counts[doc]), lists], names=["term", "doc_id", "tf", "token_count", "offsets"])


def chunks(docs: DataFrame, max_offsets: int = MAX_OFFSETS, *, places: bool = False) -> DataFrame:
    """The same postings packed in the task that makes them, a part of its documents at a time (`packed.gathered`): a term and its
    numbers stand once for many documents there, so that little is written and shuffled. doc_ids must be whole numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "body")
    return rows.mapInArrow(lambda batches: packed.gathered(_postings(batches, max_offsets, places)), packed.SCHEMA)


def term_stats(docs: DataFrame) -> DataFrame:
    """term, df (documents that have it) and cf (its tokens), counted batch by batch before they are shuffled."""

    def run(batches):
        for b in batches:
            for _, raw, at in _slices(b):
                _, cut, _, terms, _ = _grouped(raw, at)
                coded = terms.dictionary_encode()
                code = np.asarray(coded.indices)
                n = len(coded.dictionary)
                yield pa.record_batch([coded.dictionary, pa.array(np.bincount(code, minlength=n)), pa.array(np.bincount(code, np.diff(cut), n).astype(np.int64))], names=["term", "df", "cf"])

    return docs.select("doc_id", "body").mapInArrow(run, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """doc_id, body_len and token_count of every document (doc_id, body), path if there is one; without tokens: 0."""
    count = F.regexp_count(fn.byte_view("body"), F.lit(fn.TOKEN))
    path = ["path"] if "path" in docs.columns else []
    return docs.select("doc_id", *path, F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("body_len"), F.coalesce(count, F.lit(0)).cast("long").alias("token_count"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs, total_tokens, avg_len (0 if empty)."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_len"),
    )


@dataclass(frozen=True)
class Index:
    """Tables of an index. documents (doc_id, body, ...) is read for the rows that a search returns only.

    stored: postings are columns on disk, so that offsets can be read for these rows only, too. terms (term, df) and corpus
    (one row) spare a search from counting them again. blocks: the postings packed, so that a search reads those only that
    can hold its best documents; `postings` unpacks them all. chunks: the postings of an index that isn't saved yet, packed by
    the tasks that make them."""

    postings: DataFrame
    stats: DataFrame
    documents: DataFrame
    stored: bool = False
    terms: DataFrame | None = None
    corpus: DataFrame | None = None
    blocks: DataFrame | None = None
    chunks: DataFrame | None = None

    def size(self) -> tuple[int, float]:
        """Number of documents and their mean tokens."""
        row = (corpus_stats(self.stats) if self.corpus is None else self.corpus).first()
        return row["n_docs"], row["avg_len"]

    def save(self, path: str, *, with_documents: bool = False) -> None:
        """As Parquet: postings and terms in the order of terms, so that a lookup reads few row groups; documents, if asked for,
        as they stand, in the order of doc_id within each file. Where doc_ids are whole numbers, postings are packed by the tasks
        that make them, written once, shuffled as blocks and made whole blocks; elsewhere they stay as they are."""
        spark = self.postings.sparkSession
        packable = packed.packable(self.postings)
        first = self.postings
        if packable:
            first = self.chunks if self.chunks is not None else packed.partly(self.postings.withColumn("doc_id", F.col("doc_id").cast("long")))
        first.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/unsorted")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        if with_documents:
            self.documents.sortWithinPartitions("doc_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents")
        unsorted = spark.read.parquet(f"{path}/unsorted")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/unsorted")
        files = old.getFileSystem(spark._jsc.hadoopConfiguration())
        if packable:
            # so many partitions that each is sorted in memory, however large the table
            n = files.getContentSummary(old).getLength() // PART_BYTES
            by = ["term", "first_doc"]
            dealt = unsorted.repartitionByRange(n, *by) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else unsorted.repartitionByRange(*by)
            made = packed.merged(dealt.sortWithinPartitions(*by))
            made.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{path}/blocks")
            terms = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").cast("long").alias("df"))
        else:
            _sorted(unsorted, "term", "doc_id").parquet(f"{path}/postings")
            terms = unsorted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        _sorted(terms, "term").parquet(f"{path}/terms")
        corpus_stats(spark.read.parquet(f"{path}/stats")).write.mode("overwrite").parquet(f"{path}/corpus")
        files.delete(old, True)

    def save_json(self, path: str) -> None:
        """As JSON lines, one posting or document a line, for other programs."""
        self.postings.write.mode("overwrite").json(f"{path}/postings")
        self.stats.write.mode("overwrite").json(f"{path}/stats")


def _sorted(rows: DataFrame, *columns: str):
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite")


def documents_of(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of texts as documents: doc_id, body."""
    return texts.select(F.col(id_col).alias("doc_id"), fn.utf8_bytes(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))


def build_index(docs: DataFrame, max_offsets: int = MAX_OFFSETS, *, places: bool = False) -> Index:
    """An index of documents (doc_id, body) that is computed when it is used; save it to compute it once."""
    made = postings(docs, max_offsets, places=places)
    return Index(made, doc_stats(docs), docs, chunks=chunks(docs, max_offsets, places=places) if packed.packable(made) else None)


def load_index(spark: SparkSession, path: str, docs: DataFrame | None = None) -> Index:
    """docs: the documents, where the index was saved without them. An index that a stream has made has no tables of terms
    and of the corpus, since each batch would change them; they are counted when they are asked for."""

    def table(name: str) -> DataFrame | None:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = name in ("stats", "documents") or p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        return spark.read.parquet(f"{path}/{name}") if there else None

    blocks = table("blocks")
    postings = spark.read.parquet(f"{path}/postings") if blocks is None else packed.unpacked(blocks).drop("block")
    return Index(postings, table("stats"), table("documents") if docs is None else docs, True, table("terms"), table("corpus"), blocks)


def load_json(spark: SparkSession, path: str, docs: DataFrame) -> Index:
    own = docs.schema["doc_id"].dataType.simpleString()
    return Index(
        spark.read.schema(f"term string, doc_id {own}, tf long, token_count long, offsets array<long>").json(f"{path}/postings"),
        spark.read.schema(f"doc_id {own}, path string, body_len long, token_count long").json(f"{path}/stats"),
        docs,
    )

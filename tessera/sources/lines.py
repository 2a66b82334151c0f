"""Large text files in many tasks. Spark's text reader splits a file at bytes and each split at line ends: a split begins after the
first line end in it, and ends with the line that goes beyond it, so that every line is read once and none is cut or lost."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn

#: Bytes of lines that make a document.
CHUNK_BYTES = 8 << 20
_SCHEMA = "path string, split long, part long, body binary"


def splits(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    """path, size (of the file), split (the byte at which its part of the file begins) and piece, as bytes, of what stands
    between two ends; in the order of the file within a split."""
    rows = spark.read.option("lineSep", end).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def line_chunks(spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path, split, part (from 0 within a split) and body of text files of any length: whole lines, about so many bytes of
    them together, one line at least. Files without a byte have none."""
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, lines, size = None, 0, [], 0

        def done():
            body = b"\n".join(lines)
            return pa.record_batch([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([part], pa.int64()), pa.array([body], pa.binary())], names=["path", "split", "part", "body"])

        for b in batches:
            for p, s, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if lines and ((p, s) != at or size >= chunk_bytes):
                    yield done()
                    part, lines, size = (part + 1 if (p, s) == at else 0), [], 0
                elif (p, s) != at:
                    part = 0
                at = (p, s)
                lines.append(line)
                size += len(line) + 1
        if lines:
            yield done()

    return splits(spark, path).select("path", "split", "piece").mapInArrow(run, _SCHEMA)


def large_documents(spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, path, body (in UTF-8), kind and extract_status, as of `files.documents`: a document for each chunk."""
    chunks = line_chunks(spark, path, chunk_bytes=chunk_bytes)
    body = fn.utf8_bytes(fn.as_text(F.col("body")))
    status = F.when(F.octet_length("body") == 0, "empty").otherwise("ok")
    return chunks.select(F.xxhash64("path", "split", "part").alias("doc_id"), "path", body.alias("body"), F.lit("text").alias("kind"), status.alias("extract_status"))

"""Files as documents."""

from __future__ import annotations

import fnmatch
import sys
from collections.abc import Sequence
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn

from .extract import extracted


def files(spark: SparkSession, path: str, *, exclude: Sequence[str] = (), outputs: Sequence[str] = ()) -> DataFrame:
    """path, length and content of all files under a path (or of one file) in any store that Spark reads.

    Empty files are left out, and so are files under `outputs` (of this program itself) and those whose path matches a
    glob of `exclude`. A path that doesn't exist raises an error.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content").where("length > 0")
    for out in outputs:
        plain = F.regexp_replace("path", "^file:/+", "/")
        found = found.where((plain != out) & ~plain.startswith(out.rstrip("/") + "/"))
    for glob in exclude:
        found = found.where(~F.col("path").rlike(fnmatch.translate(glob)) & ~fn.title(F.col("path")).rlike(fnmatch.translate(glob)))
    return found


def documents_from(found: DataFrame) -> DataFrame:
    """doc_id (a hash of the path), path, body (the text in UTF-8), kind and extract_status of files."""
    texts = extracted(found)
    return texts.select(F.xxhash64("path").alias("doc_id"), "path", fn.utf8_bytes(F.col("text")).alias("body"), "kind", "extract_status")


def documents(spark: SparkSession, path: str, **options) -> DataFrame:
    return documents_from(files(spark, path, **options))


def from_stdin(spark: SparkSession, stream: BinaryIO | None = None) -> DataFrame:
    """What standard input holds, as the one file "stdin"; nothing if it is empty."""
    data = (stream or sys.stdin.buffer).read()
    rows = [("stdin", len(data), bytearray(data))] if data else []
    return spark.createDataFrame(rows, "path string, length long, content binary")


def write_ndjson(docs: DataFrame, path: str) -> None:
    """One JSON object a line, path and text."""
    docs.select("path", fn.as_text(F.col("body")).alias("text")).write.mode("overwrite").json(path)

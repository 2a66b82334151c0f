"""Indexing and counting what arrives (an extension: the batch engine rebuilds an index as a whole)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as fn
from tessera.operators.index import Index, doc_stats, load_index, postings
from tessera.sources.files import documents_from

#: Documents touched more than once that are broadcast, two numbers each, to the tables that may hold them; more are joined by
#: shuffling the tables.
BROADCAST_STALE = 2_000_000


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder).where("length > 0")


def index_stream(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the files that have arrived to an index's tables. A batch goes to a folder of its own, so that one that is
    run again after a failure takes its own place; N and mean length follow from all of stats."""

    def add(batch: DataFrame, batch_id: int) -> None:
        docs = documents_from(batch)
        for name, rows in (("documents", docs), ("postings", postings(docs)), ("stats", doc_stats(docs))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_changes(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps an index up with documents that are added, changed and removed. events: doc_id, body, removed (true or false) and
    changed_at; of several of a document in one batch the last one counts, of those at the same time a removal.

    Each batch is a segment: tables of the documents that it brings, and the doc_ids that it touches, of which earlier segments'
    entries no longer count. A batch that is run again takes its own place."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark, here = batch.sparkSession, f"batch={batch_id}"

        def write(rows: DataFrame, name: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{path}/{name}/{here}")
            return spark.read.schema(rows.schema).parquet(f"{path}/{name}/{here}")

        # bodies are shuffled of those documents only that have several events; what is written first is read by what follows
        counted = batch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        write(counted.select("doc_id"), "touched")
        several = counted.where("n > 1").select(F.col("doc_id").alias("several_id"))
        same = F.col("doc_id").eqNullSafe(F.col("several_id"))
        events = batch.select("doc_id", "body", "removed", "changed_at")
        alone = events.join(several, same, "left_anti")
        again = events.join(several, same, "left_semi").groupBy("doc_id").agg(F.max_by(F.struct("body", "removed"), F.struct("changed_at", "removed")).alias("last"))
        last = alone.select("doc_id", "body", "removed").unionByName(again.select("doc_id", "last.body", "last.removed"))
        docs = write(last.where(~F.coalesce("removed", F.lit(False))).select("doc_id", F.coalesce("body", F.lit(b"")).alias("body")), "documents")
        write(postings(docs), "postings")
        write(doc_stats(docs), "stats")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_changing(spark: SparkSession, path: str) -> Index:
    """The index as it is now: entries that later segments have touched are left out. Only doc_ids that were touched more than
    once are looked for in the tables."""
    touched = spark.read.parquet(f"{path}/touched")
    stale = touched.groupBy("doc_id").agg(F.max("batch").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "last")
    few = stale.limit(BROADCAST_STALE + 1).count() <= BROADCAST_STALE

    def live(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{name}")
        old = stale.withColumnsRenamed({"doc_id": "stale_id", "last": "stale_last"})
        old = F.broadcast(old) if few else old
        return rows.join(old, (F.col("doc_id") == F.col("stale_id")) & (F.col("batch") < F.col("stale_last")), "left_anti").drop("batch")

    return Index(live("postings"), live("stats"), live("documents"), True)


def compact(spark: SparkSession, path: str, into: str) -> Index:
    """The segments as one saved index, in packed blocks, in another folder; its stream goes on beside it."""
    load_changing(spark, path).save(into, with_documents=True)
    return load_index(spark, into)


def level_stream(lines: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, label and n: levels of JSON lines (ts, value) by window of event time; what comes later than `late` after
    the newest is left out."""
    found = F.regexp_extract_all("value", F.lit(r'"level":[^"]*"([^"]*)"'), F.lit(1))
    rows = lines.withWatermark("ts", late).select("ts", F.explode(found).alias("label"))
    return rows.groupBy(F.window("ts", window).alias("w"), "label").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "label", "n")


def token_stream(docs: DataFrame) -> DataFrame:
    """term and n over all texts that have arrived (doc_id, text)."""
    return docs.select(F.explode(fn.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))

"""A catalog of indexes: a small table, rewritten as a whole with each change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn

SCHEMA = "id string, name string, source_path string, index_path string, created_at timestamp, last_indexed_at timestamp, exclude_patterns array<string>"


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def list(self) -> DataFrame:
        for path in (self.path, self.path + ".old"):
            p, fs = self._path(path)
            if fs.exists(p):
                return self.spark.read.schema(SCHEMA).parquet(path)
        return self.spark.createDataFrame([], SCHEMA)

    def _rewrite(self, rows: DataFrame) -> None:
        new, fs = self._path(self.path + ".new")
        rows.coalesce(1).write.mode("overwrite").parquet(self.path + ".new")
        here, _ = self._path(self.path)
        old, _ = self._path(self.path + ".old")
        fs.delete(old, True)
        if fs.exists(here):  # `list` finds it there if the next step isn't reached
            fs.rename(here, old)
        fs.rename(new, here)
        fs.delete(old, True)

    def put(self, rows: DataFrame) -> None:
        """Inserts rows, in place of those with the same id."""
        self._rewrite(self.list().join(rows.select("id"), "id", "left_anti").select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionByName(rows))

    def delete(self, index_id: str, *, files: bool = True) -> None:
        """Takes out an entry, and its index with it."""
        for r in self.list().where(F.col("id") == index_id).collect():
            if files and r["index_path"]:
                p, fs = self._path(r["index_path"])
                fs.delete(p, True)
        self._rewrite(self.list().where(F.col("id") != index_id))


def described(entries: DataFrame, stats: DataFrame, now) -> DataFrame:
    """Entries with what a person reads: display_name, files, size and age. stats: id, path and body_len of documents."""
    sums = stats.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("body_len").alias("bytes"))
    return entries.join(sums, "id", "left").select(
        "id",
        F.when(F.length("name") > 0, F.col("name")).otherwise(fn.title(F.col("source_path"))).alias("display_name"),
        fn.count_label(F.coalesce("n", F.lit(0))).alias("files"),
        fn.size_label(F.coalesce("bytes", F.lit(0))).alias("size"),
        F.when(F.col("last_indexed_at").isNull(), "Never").otherwise(fn.age_label(F.col("last_indexed_at"), F.lit(now))).alias("age"),
    )

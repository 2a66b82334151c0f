"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans import queries as engine

QUERIES = ("index_build", "tokens", "postings", "term_df", "doc_stats", "bm25_search", "tfidf_search", "bm25_batch", "raw_search", "snippets", "match_ranges", "pattern_counts", "level_counts", "clean_markup", "rag_bundle")


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine.QUERIES["doc_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts Python workers, compiles
    seconds = {}
    for name in QUERIES:
        began = time.perf_counter()
        engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()

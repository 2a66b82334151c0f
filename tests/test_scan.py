import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scan, search


@pytest.mark.parametrize("text_ids", [False, True])
def test_tasks_hand_on_their_best_rows_only(spark, monkeypatch, text_ids):
    """raw_search_passages: the same rows as by joining what is found with the queries, ties, overlaps and letters outside ASCII included;
    from the tasks come k rows a query at most."""
    rng = random.Random(3)
    words = ["ana", "banana", "aa", "aaaa", "é", "Na", "x1", "1x", "İ", "K", "-", "\n", "nana" * 9]
    texts = [None, "", "é é", *["".join(rng.choice(words) + rng.choice(["", " ", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]]
    texts += texts[5:30]  # equal scores
    rng.shuffle(texts)
    rows = [(f"é{i}" if text_ids else i - 9, None if t is None else bytearray(t.encode())) for i, t in enumerate(texts)] + [(None, bytearray(b"ana k"))]
    docs = spark.createDataFrame(rows, f"doc_id {'string' if text_ids else 'int'}, body binary").repartition(3)
    asked = [(0, "ana aa ana"), (None, "nana K"), (7, "i x1"), (8, "none"), (9, "")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    monkeypatch.setattr(scan, "NUMBERS", 40)
    monkeypatch.setattr(scan, "RUNS", 5)
    found = search.raw_ranked(docs, queries, k=4)
    plain = search.raw_ranked(docs, queries, k=None).where("rank <= 4")  # joined
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    assert found.schema == plain.schema

    few = search.query_terms(queries).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).collect()
    low = docs.select("doc_id", F.col("body").cast("string").alias("text")).withColumn("low", F.lower("text"))
    assert scan.best(low, few, queries.schema["query_id"].dataType, 4).count() <= 3 * 4 * len(asked)


def test_rows_that_share_a_doc_id_count_as_one(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b"ab ab ab")), (1, bytearray(b"ab ab ab"))], "doc_id int, body binary").repartition(3)
    assert [tuple(r)[1:] for r in search.raw_ranked(docs, "ab", k=1).collect()] == [(1, 1, 4.0, 0)]

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.operators import packed


@pytest.fixture
def docs(spark):
    """doc_ids by turns in many partitions, so that every task has documents of all of the range."""
    made = spark.range(3000).select(((F.col("id") * 7) % 3000).alias("doc_id"), F.concat(F.lit("the "), F.repeat(F.lit("of "), (F.col("id") % 5).cast("int")), F.concat(F.lit("w"), (F.col("id") % 97).cast("string"))).alias("text"))
    return ix.documents_of(made.repartition(6))


def test_postings_are_packed_before_they_are_shuffled(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "GATHERED", 700)
    chunks = ix.build_index(docs).chunks
    assert chunks.count() * 2 < ix.postings(docs).count()
    ix.build_index(docs).save(str(tmp_path), with_documents=True)
    loaded = ix.load_index(docs.sparkSession, str(tmp_path))

    def rows(table):
        return sorted((r["term"], r["doc_id"], r["tf"], r["token_count"], tuple(r["offsets"])) for r in table.collect())

    assert rows(loaded.postings) == rows(ix.postings(docs))
    blocks = loaded.blocks.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"), F.min("first_doc").alias("low"), F.max("last_doc").alias("high")).collect()
    of = {r["term"]: r for r in blocks}
    # whole blocks again, but for one more for each border between partitions
    assert of["the"]["n"] == 3000 and -(-3000 // packed.BLOCK) <= of["the"]["blocks"] <= -(-3000 // packed.BLOCK) + 4
    assert (of["the"]["low"], of["the"]["high"]) == (0, 2999)
    assert {r["term"]: r["df"] for r in loaded.terms.collect()} == {t: r["n"] for t, r in of.items()}
    assert np.all([r["first_doc"] <= r["last_doc"] for r in loaded.blocks.collect()])


def test_marking_texts_shuffles_nothing(spark, monkeypatch):
    """However long and many the texts are: a task holds a batch of them."""
    from tessera.operators import patterns

    monkeypatch.setattr(patterns, "PLACES", 3)
    texts = spark.createDataFrame([(1, "The the aaa then"), (2, None), (3, "é THEé the"), (4, "aaaa hethe"), (5, "x")], "doc_id int, text string").coalesce(1)
    found = patterns.merged_matches(texts, ["doc_id"], ("the", "he", "aa"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: [tuple(x) for x in r["merged"]] for r in found.collect()}
    assert got == {1: [(0, 3), (4, 7), (8, 10), (12, 15)], 2: [], 3: [(2, 5), (7, 10)], 4: [(0, 4), (5, 10)], 5: []}

import hashlib

import corpus_pipeline as p
from tessera.llm.common import n_words
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def texts(df):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in df.collect())


def test_lines(spark):
    line = "one two three four five six seven"
    docs = table(spark, [(1, line, "a"), (2, f"{line}\nand this is only in here", "a"), (3, line.upper(), "a"), (4, None, "a"), (5, "", "a")])
    out = p.without_repeated_lines(spark, docs, "")
    assert texts(out) == [(False, 1, line), (False, 2, "and this is only in here"), (False, 4, None), (False, 5, "")]
    assert {r["doc_id"]: r["n_chars"] for r in out.collect()}[2] == 24


def test_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:99], "other"])
    docs = table(spark, [(7, " ".join(words), "a"), (3, near, "a"), (5, "by itself alone", "b"), (5, "by itself alone", "b"), (8, None, None), (9, "", None)])
    assert [r[1] for r in texts(p.without_near_copies(spark, docs, ""))] == [3, 5, 8, 9]


def test_mix_takes_whole_copies(spark):
    docs = table(spark, [(i, "word " * (1 + i % 7), f"s{i % 3}") for i in range(300)])
    out = p.mixed(spark, docs, "")
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3
    got, all_words = (x.agg(F.sum(n_words(F.col("text")))).first()[0] for x in (out, docs))
    assert abs(got - all_words) < 30


def test_stages_in_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]


def test_whole_run_on_the_smallest_tables(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert all(len(r["token_ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["token_ids"]).hexdigest() == r["ids_sha256"] for r in out.collect())
    assert 0 < out.select("doc_id").distinct().count() <= 200


def test_near_copies_of_one_doc_id_on_two_texts(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:99], "other"])
    docs = table(spark, [(3, " ".join(words), "a"), (5, near, "a"), (5, "a text of its own", "b"), (5, None, "b")])
    want = [(False, 3, " ".join(words)), (False, 5, "a text of its own"), (False, 5, None)]
    assert sorted(map(str, texts_of(p.without_near_copies(spark, docs, "")))) == sorted(map(str, want))


def texts_of(df):
    return [(r["doc_id"] is None, r["doc_id"], r["text"]) for r in df.collect()]


def test_near_copies_without_or_with_the_same_doc_id(spark):
    words = [f"w{i}" for i in range(100)]
    one, near, other = " ".join(words), " ".join([*words[:99], "other"]), " ".join(f"v{i}" for i in range(60))
    docs = table(spark, [(None, near, "a"), (4, one, "a"), (None, other, "b"), (None, other, "b"), (7, f"{other} more", "b"), (None, "by itself", "b"), (6, one, "a"), (6, near, "a"), (None, "", "c"), (None, "", "c"), (None, None, "c")])
    kept = texts_of(p.without_near_copies(spark, docs, ""))
    assert sorted(map(str, kept)) == sorted(map(str, [(False, 4, one), (False, 7, f"{other} more"), (True, None, "by itself"), (True, None, ""), (True, None, ""), (True, None, None)]))
    # the smallest doc_id on two near copies: one of them stays
    docs = table(spark, [(6, one, "a"), (6, near, "a"), (9, one, "a"), (6, other, "a")])
    kept = texts_of(p.without_near_copies(spark, docs, ""))
    assert len(kept) == 2 and (False, 6, other) in kept and kept[0][1] == kept[1][1] == 6

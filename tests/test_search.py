import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.operators import patterns as pt
from tessera.operators import search as se
from tessera.operators import shaping as sh


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"/d/{i}.txt", bytearray(t.encode())) for i, t in enumerate(texts)], "doc_id long, path string, body binary")


def ranked(spark, query, *texts, **options):
    return sorted((r["rank"], r["doc_id"], r["base_score"], r["score"]) for r in se.ranked(ix.build_index(docs(spark, *texts)), query, **options).collect())


def test_postings_and_stats(spark):
    table = docs(spark, "a b A", "", "é " * 3 + "b")
    assert sorted(tuple(r) for r in ix.postings(table).collect()) == [("a", 0, 2, 3, [0, 4]), ("b", 0, 1, 3, [2]), ("b", 2, 1, 1, [9])]
    assert sorted(tuple(r) for r in ix.doc_stats(table).collect()) == [(0, "/d/0.txt", 5, 3), (1, "/d/1.txt", 0, 0), (2, "/d/2.txt", 10, 1)]
    assert tuple(ix.corpus_stats(ix.doc_stats(table)).first()) == (3, 4, 4 / 3)
    many = ix.postings(docs(spark, "x " * 300)).first()
    assert (many["tf"], len(many["offsets"]), many["offsets"][-1]) == (300, 128, 254)
    assert tuple(ix.corpus_stats(ix.doc_stats(table.where("false"))).first()) == (0, 0, 0.0)


def test_term_frequency_orders(spark):
    got = ranked(spark, "apple", "apple apple apple padone padtwo", "apple padone padtwo padthree padfour")
    assert [(d, round(s, 6)) for _, d, s, _ in got] == [(0, 0.286505), (1, 0.182322)]
    got = ranked(spark, "mango", "mango mango mango fruit fruit fruit", "carrot vegetable greens mango")
    assert [(d, round(s, 6)) for _, d, s, _ in got] == [(0, 0.274731), (1, 0.198568)]


def test_cut(spark):
    texts = ("apple apple apple filler one two three", "apple apple filler one two three four", "apple filler one two three four five")
    assert [(d, round(s, 6)) for _, d, s, _ in ranked(spark, "apple", *texts, k=2)] == [(0, 0.209835), (1, 0.183606)]
    assert len(ranked(spark, "apple", *texts, k=None)) == 3 and ranked(spark, "apple", *texts, k=0) == []
    with pytest.raises(ValueError, match="negative"):
        ranked(spark, "apple", *texts, k=-1)


def test_proximity_boosts_but_does_not_rerank(spark):
    pads = " ".join(f"pad{i}" for i in range(1, 9))
    got = ranked(spark, "alpha beta", f"alpha {pads} beta", f"alpha beta {pads}")
    assert [(d, round(b, 6), round(s, 6)) for _, d, b, s in got] == [(1, 0.364643, 0.401777), (0, 0.364643, 0.387198)]


def test_repeated_terms_count_twice(spark):
    (_, _, base, score), = ranked(spark, "a a", "a b")
    one, = ranked(spark, "a", "a b")
    assert math.isclose(base, 2 * one[2]) and math.isclose(score, base * 1.3)


def test_no_terms_no_rows(spark):
    for q in ("", "  \t", "éé", "unknown"):
        assert ranked(spark, q, "a b c") == []
    with pytest.raises(RuntimeError):
        se.search(None, "test")


def test_tf_idf(spark):
    got = ranked(spark, "a", "a a b b", "c", use_bm25=False)
    assert math.isclose(got[0][2], 2 * math.log(1 + 1.5 / 1.5) / 4)


def test_many_queries_at_once(spark):
    queries = spark.createDataFrame([(7, "apple"), (9, "pear apple"), (11, "")], "query_id int, query string")
    rows = se.search(ix.build_index(docs(spark, "apple pie", "pear tart")), queries).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in rows) == [(7, 0), (9, 0), (9, 1)]
    assert {r["path"] for r in rows} == {"/d/0.txt", "/d/1.txt"}


def test_many_terms_are_joined(spark, monkeypatch):
    texts = ("apple pie", "pear tart and apple")
    want = ranked(spark, "apple pear tart", *texts)
    monkeypatch.setattr(se, "PUSHED_TERMS", 1)
    assert ranked(spark, "apple pear tart", *texts) == want


def test_raw_search(spark):
    table = docs(spark, "ååå test appears after multibyte chars", "concatenate a cat", "TEST Test test with trailing text", "The exact literal token [abc] appears here once.")
    hit = se.raw_search(table, "test").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"], r["match_offset"]) for r in hit] == [(2, 3.0, 0), (0, 1.0, 7)]
    assert [(r["start"], r["end"]) for r in hit[0]["match_ranges"]] == [(0, 4), (5, 9), (10, 14)]
    assert [(r["doc_id"], r["score"]) for r in se.raw_search(table, "cat").collect()] == [(1, 2.0)]
    literal = se.raw_search(table, "[abc]").first()
    assert literal["matched_terms"] == ["abc"] and "[abc]" in literal["snippet"]
    assert se.raw_search(table, " ").collect() == []


def test_falls_back_to_scanning(spark):
    table = docs(spark, "concatenate")
    assert se.search_any(table, "cat").count() == 1 and se.search_any(table, "cat", ix.build_index(table)).count() == 0


def test_save_and_load(spark, tmp_path):
    table = docs(spark, "apple pie", "pear tart", "")
    index = ix.build_index(table)
    index.save(f"{tmp_path}/p")
    index.save_json(f"{tmp_path}/j")
    want = sorted(map(str, se.search(index, "apple tart").collect()))
    for loaded in (ix.load_index(spark, f"{tmp_path}/p", table), ix.load_json(spark, f"{tmp_path}/j", table)):
        assert loaded.size() == index.size()
        assert sorted(map(str, se.search(loaded, "apple tart").collect())) == want


def test_terms_reach_the_scan(spark, tmp_path, capsys):
    table = docs(spark, "apple pie", "pear tart")
    ix.build_index(table).save(f"{tmp_path}/p")
    se.ranked(ix.load_index(spark, f"{tmp_path}/p", table), "apple").explain("formatted")
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,apple)" in (plan := capsys.readouterr().out) or "In(term, [apple])" in plan


def test_counts(spark):
    table = docs(spark, "aaaa AA é", '{"level":"INFO"} {"level": "warn"} {"level":5,"m":"x"} {"level":"INFO"}', "")
    assert sorted(tuple(r) for r in pt.pattern_counts(table, ["aa", "é", "none"]).collect()) == [("aa", 3), ("none", 0), ("é", 1)]
    assert sorted(tuple(r) for r in pt.level_counts(table).collect()) == [("INFO", 2), ("m", 1), ("warn", 1)]
    pdfs = docs(spark, "%PDF-1.4 /Filter /Filter", "/Filter")
    assert [tuple(r) for r in pt.compressed_streams(pdfs).collect()] == [("compressedStreams", 2)]


def test_shaping(spark):
    table = docs(spark, "apple pie.", "apple apple.")
    queries = spark.createDataFrame([(0, "apple")], "query_id int, query string")
    hits = se.search(ix.build_index(table), queries)
    assert sh.bundle(hits).first()["bundle"].startswith("path: /d/1.txt\nscore: 0.2") and sh.SEPARATOR in sh.bundle(hits).first()["bundle"]
    asked = sh.prompts(hits, queries)
    assert "apple apple." + sh.SEPARATOR + "apple pie." in asked.first()["prompt"]
    assert sh.answered(asked, lambda p: str(len(p))).first()["answer"].isdigit()
    assert '"query":"apple"' in sh.payloads(hits, queries).first()["payload"]
    assert [tuple(r) for r in sh.file_type_stats(table.select("path").union(spark.createDataFrame([("x",), ("",)], "path string"))).collect()] == [("TXT", 2, 2 / 3), ("No ext", 1, 1 / 3)]
    assert sh.listing(hits).where(F.col("rank") == 1).first()["line"].startswith("---\n/d/1.txt\n0.2")


def test_merged_matches_reach_the_end_of_long_texts(spark):
    texts = ["x" * 600 + " The then", "", None, "hehe " + "." * 40_000 + "THE", "thethe", "thethe"]
    rows = spark.createDataFrame(list(enumerate([*texts, *texts])), "id long, text string")
    found = {r["id"]: [tuple(m) for m in r["merged"]] for r in pt.merged_matches(rows, ["id"], ["the", "he", "en"]).collect()}
    want = [[(601, 604), (605, 609)], [], [], [(0, 4), (40_005, 40_008)], [(0, 6)], [(0, 6)]]
    assert found == dict(enumerate([*want, *want]))
    same = pt.merged_matches(spark.createDataFrame([(1, "the"), (1, "no"), (1, "the")], "id long, text string"), ["id"], ["the"]).collect()
    assert sorted(len(r["merged"]) for r in same) == [0, 1, 1]


def test_batch_asks_whole_passages(spark, tmp_path):
    """A document that holds the rest of a passage, but not its first three words, is found; more terms than are pushed."""
    from tessera.plans import queries

    words = [f"w{i}" for i in range(se.PUSHED_TERMS + 50)]
    spark.createDataFrame([(1, " ".join(words[100:140])), (2, "other text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words)), (8, "w0 w1 w2 w139")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.QUERIES["bm25_batch"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in found) == [(7, 1, 1), (8, 1, 1)]
    assert queries.bm25_batch(spark, str(tmp_path)).collect() == found

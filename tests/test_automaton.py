import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import automaton
from tessera.operators import index as ix
from tessera.operators import patterns as pt
from tessera.operators import search as se


def docs(spark, n=300, seed=1):
    rng = random.Random(seed)
    pieces = ["the ", "aa", "a", "é", "日本", "The", "ab", "\n", "🙂", "x1", "İ", "ß "]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "aaaaaaa")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def overlapping(text, pattern):
    return sum(text.startswith(pattern, i) for i in range(len(text) - len(pattern) + 1)) if pattern else 0


@pytest.mark.parametrize("any_case", [False, True])
def test_patterns_like_one_by_one(spark, any_case):
    table = docs(spark)
    wanted = ["aa", "a", "the", "The", "é", "", "none", "a\n", "日", "AA"]
    got = {r["label"]: r["n"] for r in pt.pattern_counts(ix.documents_of(table), wanted, ignore_case=any_case).collect()}

    def fold(b):
        return b.lower() if any_case else b

    texts = [(r["text"] or "").encode() for r in table.collect()]
    assert got == {p: sum(overlapping(fold(t), fold(p.encode())) for t in texts) for p in wanted}
    assert sum(r["n"] for r in pt.pattern_counts(ix.documents_of(table.where("doc_id < 0")), ["a"]).collect()) == 0


def slow_raw(texts, queries, k):
    out = []
    for q, query in queries:
        terms = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in query).split()
        rows = []
        for d, t in texts:
            low = t.lower()
            score = sum(low.count(x) for x in terms)
            if score:
                first = min(low.find(x) for x in terms if x in low)
                rows.append((-score, d, len(t[:first].encode())))
        out += [(q, i + 1, d, float(-s), at) for i, (s, d, at) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("together", [200_000, 2])
def test_raw_search_like_one_by_one(spark, monkeypatch, together):
    monkeypatch.setattr(automaton, "LITERALS", together)
    table = docs(spark).where(~F.col("text").contains("İ") | F.col("text").isNull())  # its lower case has two characters
    asked = [(0, "aa the"), (1, "a a x1"), (2, "none"), (3, "é!"), (4, "B"), (5, "aaa")]
    found = se.raw_ranked(ix.documents_of(table), spark.createDataFrame(asked, "query_id int, query string"), k=7).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in table.collect()]
    assert sorted(map(tuple, found)) == slow_raw(texts, asked, 7)


def test_many_patterns_and_queries(spark):
    table = ix.documents_of(docs(spark, 60))
    many = [f"w{i}x" for i in range(10_000)] + ["the"]
    got = pt.pattern_counts(table, many)
    assert got.count() == 10_001 and got.where("n > 0").count() == 1
    queries = spark.range(10_000).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), F.col("id").cast("string"), F.lit("z the")).alias("query"))
    found = se.raw_ranked(table, queries, k=1)
    assert found.count() == 10_000 and found.select("doc_id").distinct().count() == 1


def test_ranges_are_linear_and_as_before(spark):
    rng = random.Random(2)
    lists = [[(rng.choice([None, *range(-2, 40)]), rng.choice([None, *range(0, 50)])) for _ in range(rng.randint(0, 12))] for _ in range(300)]

    def slow(ranges):
        out = []
        for s, e in sorted((s, e) for s, e in ranges if s is not None and e is not None and s >= 0 and e > s):
            if out and out[-1][1] >= s:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
        return out

    table = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, r array<struct<start:int,end:int>>")
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in table.select("i", fn.merged_ranges(F.col("r")).alias("m")).collect()}
    assert got == {i: slow(x) for i, x in enumerate(lists)}


def test_long_texts_are_marked_whole(spark):
    words = " ".join(f"word{i % 97} ana nna" for i in range(20_000))
    row = spark.createDataFrame([(words,), (None,)], "t string")
    ranges = row.select(fn.fallback_ranges(F.col("t"), F.array(F.lit("word1"), F.lit("ana"), F.lit("nn"))).alias("m")).collect()
    want = sum(words.count(x) for x in ("ana", "nna"))
    assert ranges[1]["m"] is None and len(ranges[0]["m"]) > want // 2 and ranges[0]["m"][-1]["end"] == len(words) - 1

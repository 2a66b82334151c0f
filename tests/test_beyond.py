"""Phrases, conditions, spellings, and an index that changes: what goes beyond bags of tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import fuzzy, phrases
from tessera.operators import index as ix
from tessera.operators import search as se
from tessera.operators.boolean import field, matches, prefix, term
from tessera.streaming import index as st

WORDS = ["red", "green", "blue", "of", "the", "sea", "größe"]


def texts(n=200, seed=4):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for i in range(n)} | {900: "of of of " * 200 + "the sea", 901: "", 902: "!!", 903: "Red-SEA"}


def tokens(text):
    return re.findall(r"[a-z0-9]+", "".join(c.lower() if c.isascii() else " " for c in text))


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    docs = ix.documents_of(spark.createDataFrame(list(texts().items()), "doc_id long, text string"))
    docs = docs.withColumn("path", F.concat(F.lit("/d/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")))
    plain, places = (str(tmp_path_factory.mktemp(n)) for n in ("plain", "places"))
    ix.build_index(docs).save(plain, with_documents=True)
    phrases.build_positions(docs).save(places)
    return ix.load_index(spark, plain), phrases.load_positions(spark, places, docs), ix.build_index(docs), phrases.build_positions(docs)


def test_phrases(spark, indexes):
    asked = [(0, "the sea"), (1, "of of"), (2, "red"), (3, "Red-sea of"), (4, ""), (5, "gr"), (6, "none of"), (7, "of the sea")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = []
    for q, query in asked:
        w = tokens(query)
        for d, t in texts().items():
            have = tokens(t)
            at = [i for i in range(len(have) - len(w) + 1) if w and have[i : i + len(w)] == w]
            if at:
                want.append((q, d, len(at), at[0]))
    for positions in (indexes[1], indexes[3]):
        assert sorted(map(tuple, phrases.phrase_matches(positions, queries).collect())) == sorted(want)
    best = phrases.phrase_search(indexes[1], "of of", k=2).collect()
    assert [(r["rank"], r["doc_id"], r["n"]) for r in best][0] == (1, 900, 599)


def test_conditions(spark, indexes):
    asked = {
        "and": term("Red") & term("sea"),
        "nested": (term("red") | ~(term("blue") & prefix("gr"))) & ~term("of"),
        "none": ~term("red") & ~term("green"),
        "field": term("the") & field(F.col("path").endswith(".md")) & ~field(F.col("token_count") > 10),
        "only field": field(F.col("token_count") == 0),
        "unknown": term("zzz"),
    }

    def holds(name, d, have):
        has, starts = have.__contains__, lambda p: any(x.startswith(p) for x in have)
        return {
            "and": has("red") and has("sea"),
            "nested": (has("red") or not (has("blue") and starts("gr"))) and not has("of"),
            "none": not has("red") and not has("green"),
            "field": has("the") and d % 2 == 0 and not len(have) > 10,
            "only field": not have,
            "unknown": False,
        }[name]

    want = sorted((name, d) for name in asked for d, t in texts().items() if holds(name, d, tokens(t)))
    for index in (indexes[0], indexes[2]):
        assert sorted(map(tuple, matches(index, asked).collect())) == want
    assert sorted(map(tuple, matches(indexes[0], {"red": asked["and"]}).collect())) == sorted(("red", d) for n, d in want if n == "and")
    assert matches(indexes[0], {}).count() == 0
    with pytest.raises(ValueError):
        term("two words")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("together", [1000, 2])
def test_spellings(spark, indexes, monkeypatch, distance, together):
    monkeypatch.setattr(fuzzy, "WORDS", together)
    words = ["rad", "gren", "sea", "th", "", "ofof", "xyz", "RED"]
    found = fuzzy.fuzzy_terms(indexes[0], spark.createDataFrame([(w,) for w in [*words, "rad", None]], "word string"), distance=distance).collect()
    df = {}
    for t in texts().values():
        for w in set(tokens(t)):
            df[w] = df.get(w, 0) + 1
    want = [(w.lower(), t, df[t], edits(w.lower(), t)) for w in dict.fromkeys(x.lower() for x in words) for t in df if edits(w.lower(), t) <= distance]
    assert sorted(map(tuple, found)) == sorted(want)


def test_corrected_queries(spark, indexes):
    queries = spark.createDataFrame([(0, "rad see of"), (1, "qqqq"), (2, "the")], "query_id int, query string")
    assert {r["query_id"]: r["query"] for r in fuzzy.corrected(indexes[0], queries).collect()} == {0: "red sea of", 1: "qqqq", 2: "the"}
    assert fuzzy.fuzzy_ranked(indexes[0], "rad", k=3).drop("query_id").collect() == se.ranked(indexes[0], "red", k=3).drop("query_id").collect()


def test_an_index_that_changes(spark, tmp_path):
    schema = "doc_id long, body binary, removed boolean, changed_at timestamp"
    batches = [
        [(1, "red sea", False, 1), (2, "blue sea", False, 1), (3, "of the sea", False, 1)],
        [(2, "green tree", False, 2), (3, None, True, 2), (4, "old", False, 2), (4, "new sea", False, 3)],
        [(1, "red red", False, 4), (3, "sea again", False, 4), (5, "gone", False, 4), (5, None, True, 4), (9, None, True, 4)],
    ]
    live = {}
    for n, rows in enumerate(batches):
        times = spark.createDataFrame([(d, t or "", gone, at) for d, t, gone, at in rows], "doc_id long, t string, removed boolean, at int")
        events = times.select("doc_id", F.encode("t", "UTF-8").alias("body"), "removed", F.timestamp_seconds("at").alias("changed_at"))
        events.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/events")
        st.index_changes(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination()
        for d, t, gone, _ in rows:
            live.pop(d, None)
            if not gone:
                live[d] = t
        fresh = ix.build_index(ix.documents_of(spark.createDataFrame(list(live.items()), "doc_id long, text string")))
        want = [sorted(map(str, se.ranked(fresh, q, k=5).collect())) for q in ("sea", "red of", "gone")]
        changing = st.load_changing(spark, f"{tmp_path}/index")
        assert [sorted(map(str, se.ranked(changing, q, k=5).collect())) for q in ("sea", "red of", "gone")] == want
    packed = st.compact(spark, f"{tmp_path}/index", f"{tmp_path}/compact")
    assert packed.blocks is not None and [sorted(map(str, se.ranked(packed, q, k=5).collect())) for q in ("sea", "red of", "gone")] == want


def test_what_changed_is_broadcast_to_the_segments(spark, tmp_path):
    """The tables of an index that changes aren't shuffled by doc_id, whatever Spark would broadcast by itself."""
    for batch, ids in ((0, [1, 2]), (1, [2])):
        for name in ("touched", "postings", "stats", "documents"):
            spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/{name}/batch={batch}")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = st.load_changing(spark, str(tmp_path)).postings
        assert sorted(r["doc_id"] for r in rows.collect()) == [1, 2]
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)

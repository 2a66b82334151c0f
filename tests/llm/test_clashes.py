"""Tables whose extra columns are named like every helper column of the operators: they come back as they were."""

import inspect
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, infill, lines, mixing, sharding, token_counts, vector_codes, wrappers

OWN = {"doc_id", "text", "source", "lang", "n_chars", "url", "html", "vec_id", "embedding", "label"}


def helpers(*modules):
    """Every quoted word of the modules that could be a column."""
    found = set()
    for m in modules:
        found |= set(re.findall(r"[\"'f]([A-Za-z_][A-Za-z0-9_]*)[\"']", inspect.getsource(m))) | {"carried0", "carried1"}
    lower = {}
    for name in sorted(found):
        lower.setdefault(name.lower(), name)
    return [n for low, n in sorted(lower.items()) if low not in OWN and len(n) < 40]


def clashing(df, *modules):
    return df.withColumns({n: F.lit(f"={n}") for n in helpers(*modules)})


def intact(rows, *modules, but=()):
    rows = rows if isinstance(rows, list) else rows.collect()
    names = [n for n in helpers(*modules) if n.lower() not in but]
    assert rows and len(names) > 5 and all(r[n] == f"={n}" for r in rows for n in names)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(i, f"{line} {i % 7}\nshort {i}", "en", f"s{i % 3}", 1) for i in range(40)] + [(5, None, None, None, None), (None, "", "de", "s1", 0), (3, f"{line} 3\nshort 3", "en", "s0", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_lines(docs):
    intact(lines.deduplicated(clashing(docs, lines, common)), lines, common, but=("n_lines", "dropped_lines"))


def test_mix(docs):
    out = ("size", "source_size", "target", "copies", "taken")
    rows = intact(mixing.mix(clashing(docs, mixing, common)), mixing, common, but=out)
    assert sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in rows) == sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in mixing.mix(docs).collect())
    sized = docs.withColumns({"_words": F.lit(3), "copies": F.lit(1)})
    assert {r["size"] for r in mixing.mix(sized, size_col="_words").collect()} == {3} and {r["size"] for r in mixing.mix(sized, size_col="copies").collect()} == {1}


def test_shards(docs):
    table = clashing(docs, sharding, common).drop("size").withColumns({"size": F.length(F.coalesce("text", F.lit(""))) + 1, "th": common.shuffle_key(F.col("text")), "rh": common.shuffle_key(F.col("doc_id"))})
    out = sharding.shards(table, ["lang", "size"], size_col="size", text_hash="th", row_hash="rh", n_shards=4)
    intact(out, sharding, common, but=("shard", "slot", "size"))


def test_tokenizers(docs):
    intact(bpe.encoded(clashing(docs, bpe, common)), bpe, common, but=("token_ids", "decoded"))
    assert token_counts.token_counts(clashing(docs, token_counts, common)).count() == docs.count()


def test_new_operators(spark, docs):
    made = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")
    intact(infill.filled(clashing(docs, infill, common)), infill, common, but=made)
    pages = docs.select("doc_id", F.lit("http://a.example.com/").alias("url"), F.concat(F.lit("<article><p>"), "text").alias("html"))
    intact(wrappers.extracted(clashing(pages, wrappers, common)), wrappers, common, but=("text", "n_chars"))
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(0.5), F.col("doc_id") / 10).alias("embedding"), F.col("source").alias("label")).where("vec_id is not null")
    table = clashing(vectors, vector_codes, common)
    coded = vector_codes.encoded(table, *vector_codes.fitted(table, parts=2, entries=4))
    intact(coded, vector_codes, common, but=("code", "error"))


@pytest.mark.parametrize("stage", ["without_repeated_lines", "without_near_copies", "mixed"])
def test_stages(spark, docs, stage):
    modules = corpus_pipeline, lines, mixing, common
    table = clashing(docs, *modules)
    out = getattr(corpus_pipeline, stage)(spark, table, "")
    assert out.columns == table.columns
    intact(out, *modules)


def test_rows_that_differ_in_source_only(spark):
    """The same one stays on every run: the smallest."""
    rows = [(1, "one two three four five six", "en", s, 1) for s in ("c", "a", "b")]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        assert [r["source"] for r in corpus_pipeline.without_near_copies(spark, table, "").collect()] == ["a"]

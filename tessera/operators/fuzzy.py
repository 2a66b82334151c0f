"""Terms that are spelled nearly like others. The terms of an index are a table of their own, so that a look at each of them is one
narrow scan, and Spark's banded edit distance stops at the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn

from .index import Index
from .search import query_terms, queries_of, ranked

#: Words that meet the terms in one scan; more come in several blocks.
WORDS = 1000


def fuzzy_terms(index: Index, words: DataFrame, *, distance: int = 1) -> DataFrame:
    """word, term, df and distance: the index' terms within so many insertions, deletions and replacements of each of the different
    words (word) of a table, which are lower-case tokens. The words stand in the plan, WORDS at a time."""
    if distance < 0:
        raise ValueError("distance must not be negative")
    terms = index.terms if index.terms is not None else index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    different = words.select(fn.lower_ascii(F.col("word")).alias("word")).where("word is not null").distinct()
    blocks = max(1, -(-different.count() // WORDS))
    out = None
    for block in range(blocks):
        # one row for the whole block, beside which the terms stay where they are
        mine = [r["word"] for r in different.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block).toLocalIterator()]
        some = F.array(*map(F.lit, sorted(mine))).cast("array<string>")
        near = F.filter(some, lambda w: F.abs(F.length(w) - F.length("term")) <= distance)
        met = terms.select("term", "df", F.explode(near).alias("word")).withColumn("distance", F.levenshtein("word", "term", distance)).where("distance >= 0")
        part = met.select("word", "term", F.col("df").cast("long").alias("df"), "distance")
        out = part if out is None else out.unionByName(part)
    return out


def corrected(index: Index, query: str | DataFrame, *, distance: int = 1) -> DataFrame:
    """query_id and query: each token that the index doesn't have replaced by the nearest term that it has, the one in more
    documents among equally near ones, then the first by letters; tokens without any stay."""
    asked = query_terms(queries_of(index.stats.sparkSession, query))
    known = index.terms if index.terms is not None else index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    missing = asked.select("term").distinct().join(known.select("term"), "term", "left_anti").withColumnRenamed("term", "word")
    best = fuzzy_terms(index, missing, distance=distance).groupBy("word").agg(F.min(F.struct("distance", (-F.col("df")).alias("rare"), "term")).alias("best"))
    put = asked.join(best, asked["term"] == best["word"], "left").select("query_id", "qi", F.coalesce("best.term", asked["term"]).alias("term"))
    return put.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qi", "term"))), lambda x: x["term"]), " ").alias("query"))


def fuzzy_ranked(index: Index, query: str | DataFrame, *, distance: int = 1, **options) -> DataFrame:
    """`search.ranked` with the corrected queries."""
    return ranked(index, corrected(index, query, distance=distance), **options)

"""Phrases: the places where a query's tokens follow each other.

The index of positions has the places, counted in tokens, of all tokens of each term in each document, in packed blocks as those
of offsets; only searches for phrases read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .index import Index, build_index, load_index
from .search import _hits, queries_of, query_terms

#: More than any document has.
ALL = 1 << 31


def build_positions(docs: DataFrame) -> Index:
    """An index of documents (doc_id, body) whose offsets are places in tokens, all of them; to be saved like others."""
    return build_index(docs, ALL, places=True)


def load_positions(spark: SparkSession, path: str, docs: DataFrame | None = None) -> Index:
    return load_index(spark, path, docs)


def phrase_matches(positions: Index, query: str | DataFrame) -> DataFrame:
    """query_id, doc_id, n (places at which all tokens of the query follow each other, overlapping ones included) and first (the
    first of them, in tokens from 0), of documents that have any. A query without tokens finds nothing.

    A document's places of each token are moved by the token's place in the query and intersected, the shortest list first."""
    terms = query_terms(queries_of(positions.stats.sparkSession, query))
    wanted = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    rows = _hits(positions, terms, with_offsets=True).join(terms, "term")
    moved = F.transform("offsets", lambda p: p - F.col("qi"))
    docs = rows.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct(F.size("offsets").alias("n"), "qi", moved.alias("at")))).alias("lists"))
    # documents with all tokens only
    docs = docs.join(wanted, "query_id").where(F.size("lists") == F.col("size"))
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.element_at("lists", 1)["at"], lambda acc, x: F.array_intersect(acc, x["at"]))
    found = docs.select("query_id", "doc_id", both.alias("starts")).where(F.size("starts") > 0)
    return found.select("query_id", "doc_id", F.size("starts").cast("long").alias("n"), F.array_min("starts").alias("first"))


def phrase_search(positions: Index, query: str | DataFrame, *, k: int = 10) -> DataFrame:
    """The k documents of each query that have its phrase most often: query_id, rank, doc_id, n, first."""
    best = Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id")
    ranked = phrase_matches(positions, query).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "n", "first")


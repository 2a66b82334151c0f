"""Keyword search, many queries at a time: ranked by an index, or by scanning texts.

A query is a bag of tokens, all optional; repeated ones count each time. Queries are a DataFrame of query_id and query,
or one string (query_id 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.sources.scratch import drop, written

from . import automaton, packed, pruning, scan, together
from .index import Index

K1, B, PROXIMITY_WEIGHT = 1.2, 0.75, 0.3
RESULTS, WINDOW = 10, 1200
#: Terms that are looked up by a filter that reaches the scan; more are joined.
PUSHED_TERMS = 200
#: Result rows, k for each query, that are broadcast to the scan of bodies; more are joined by shuffling. Of so few
#: documents the doc_ids reach the scan as a filter, one by one.
BROADCAST_ROWS, PUSHED_DOCS = 50_000, 500
#: Postings of the queries' terms from which on a search looks first which blocks of them it needs.
PRUNED_POSTINGS = 1_000_000
#: Postings of the queries' terms, counted for each query, from which on queries that share them are scored together; they share
#: them if they are so many times as many as the terms' own.
SHARED_POSTINGS, SHARED_TIMES = 1_000_000, 2
#: Terms of result rows whose places are broadcast to the scan of offsets.
BROADCAST_PLACES = 500_000
#: Terms of all queries, and result rows of each task, up to which a scan sums scores where the texts are; of more, row by row.
SCANNED_TERMS, SCANNED_ROWS = 200_000, 500_000


def queries_of(spark: SparkSession, query: str | DataFrame) -> DataFrame:
    return query.select("query_id", "query") if isinstance(query, DataFrame) else spark.createDataFrame([(0, query)], "query_id int, query string")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, qi (the place in the query, from 0) and term. A query without tokens has no rows."""
    return queries.select("query_id", F.posexplode(fn.tokens(F.col("query"))).alias("qi", "term"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, avg_len: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """weight: the term's idf. Lengths count as average where the average is 0."""
    ratio = F.when(avg_len == 0, F.lit(1.0)).otherwise(length / avg_len)
    below = tf + k1 * (1 - b + b * ratio)
    return weight * tf * (k1 + 1) / F.when(below == 0, F.lit(1.0)).otherwise(below)


def tf_idf(tf: Column, length: Column, weight: Column) -> Column:
    return tf * weight / F.when(length == 0, F.lit(1)).otherwise(length)


def _looked_up(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Of rows with terms, those of all terms of all queries."""
    words = [r["term"] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(words) <= PUSHED_TERMS:
        return rows.where(F.col("term").isin(words))
    return rows.join(terms.select("term").distinct(), "term", "left_semi")


def scorer(use_bm25: bool, k1: float, b: float, avg_len: float) -> pruning.Score:
    """The score of a term in a document as a function of its tf, the document's tokens and the term's idf."""
    if use_bm25:
        return lambda tf, length, weight: bm25(tf, length, F.lit(avg_len), weight, k1, b)
    return tf_idf


def array_scorer(use_bm25: bool, k1: float, b: float, avg_len: float):
    """`scorer` for numpy arrays of positive tf and lengths: the same operations in the same order."""

    def part(tf, length, weight):
        if not use_bm25:
            return tf * weight / length
        ratio = 1.0 if avg_len == 0 else length / avg_len
        return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))

    return part


def weighted(index: Index, terms: DataFrame, n_docs: int) -> DataFrame:
    """query_id, qi, term and idf of the queries' terms that the index has."""
    if index.terms is None:
        df = _looked_up(index.postings.select("term"), terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        df = _looked_up(index.terms, terms)
    return terms.join(df, "term").select("query_id", "qi", "term", idf(F.lit(n_docs), F.col("df")).alias("idf"))


def _hits(index: Index, terms: DataFrame, *, with_offsets: bool) -> DataFrame:
    """The postings of all terms of all queries; those of a packed index with their blocks."""
    if index.blocks is not None:
        return packed.unpacked(_looked_up(index.blocks, terms), with_offsets=with_offsets)
    rows = _looked_up(index.postings, terms)
    return rows if with_offsets else rows.drop("offsets")


def _worth_it(index: Index, terms: DataFrame) -> bool:
    return index.terms is not None and (_looked_up(index.terms, terms).agg(F.sum("df").alias("n")).first()["n"] or 0) >= PRUNED_POSTINGS


def _shared(index: Index, terms: DataFrame) -> bool:
    """Whether queries share so many postings that these are better dealt out once for all of them."""
    if index.terms is None:
        return False
    times = terms.groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    sums = _looked_up(index.terms, terms).join(times, "term").agg(F.sum(F.col("df") * F.col("times")).alias("all"), F.sum("df").alias("own"), F.sum("times").alias("weights")).first()
    return (sums["all"] or 0) >= SHARED_POSTINGS and sums["all"] >= SHARED_TIMES * sums["own"] and sums["weights"] <= together.WEIGHTS


def proximity(places: Column) -> Column:
    """Of an array of (off, qi) in order: the smallest gap of neighbours of different query terms, the earliest such,
    as struct<gap, left, center>; null without any."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(places) - 1),
        lambda i: F.struct(
            (F.element_at(places, i + 1)["off"] - F.element_at(places, i)["off"]).alias("gap"),
            F.element_at(places, i)["off"].alias("left"),
            F.floor((F.element_at(places, i)["off"] + F.element_at(places, i + 1)["off"] + 1) / 2).alias("center"),
            (F.element_at(places, i)["qi"] != F.element_at(places, i + 1)["qi"]).alias("apart"),
        ),
    )
    return F.when(F.size(places) > 1, F.array_min(F.filter(pairs, lambda p: p["apart"])))


def boosted(score: Column, gap: Column, weight: float = PROXIMITY_WEIGHT) -> Column:
    return F.when(gap.isNull(), score).otherwise(score * (1 + F.lit(weight) / (1 + F.log1p(gap))))


def ranked(index: Index, query: str | DataFrame, *, k: int | None = RESULTS, use_bm25: bool = True, k1: float = K1, b: float = B, proximity_weight: float = PROXIMITY_WEIGHT, rerank: bool = False, prune: bool | None = None) -> DataFrame:
    """query_id, rank, doc_id, base_score, score (with the proximity boost), gap, match_offset, terms.

    Ranks and the cut after k follow the base score, ties the boosted one, then doc_id; with rerank both follow the
    boosted score first. k None: no cut.

    prune: read only the blocks of a packed index that can hold one of the k best by base score, which gives the same rows;
    None: if the terms have PRUNED_POSTINGS or more. Queries that share so many postings that reading them for each query costs more
    are scored together instead (`together`), by all postings of their terms, unless prune is False. Scores must fall with a document's length and grow with tf (k1 from 0
    on, b from 0 to 1), else all are read.
    """
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    terms = query_terms(queries_of(index.postings.sparkSession, query))
    cut = k is not None and not rerank
    later = cut and index.stored
    n_docs, avg_len = index.size()
    score, weights = scorer(use_bm25, k1, b, avg_len), weighted(index, terms, n_docs)
    can = cut and k and index.blocks is not None and k1 >= 0 and 0 <= b <= 1
    used = []
    at_once = can and prune is not False and _shared(index, terms)
    if at_once:
        docs = together.best(_looked_up(index.blocks, terms), weights, k, n_docs, array_scorer(use_bm25, k1, b, avg_len))
    elif can and (_worth_it(index, terms) if prune is None else prune):
        blocks = _looked_up(index.blocks, terms)
        placed, folder = written(pruning.in_cells(blocks, weights, score), "cells")
        wanted = pruning.promising(blocks, placed, weights, k, score)
        rows = pruning.read(blocks, wanted).join(wanted, ["term", "block"])
        used.append(folder)
    else:
        rows = _hits(index, terms, with_offsets=not later).join(weights, "term")
    if not at_once:
        part = score(F.col("tf"), F.col("token_count"), F.col("idf"))
        rows = rows.select("query_id", "doc_id", F.struct("qi", part.alias("part"), "term", *(c for c in rows.columns if c in ("block", "offsets"))).alias("part"))
        # sums in a fixed order, so that equal documents have equal scores; rows of a pair are the query's terms
        docs = rows.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    docs = docs.withColumn("base_score", F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["part"]))
    if cut:
        # neighbours matter for the rows that the base score can keep; equal scores at the cut included
        best = Window.partitionBy("query_id").orderBy(F.desc("base_score"))
        docs = docs.withColumn("_place", F.rank().over(best)).where(F.col("_place") <= k).drop("_place")
    if used or at_once:  # the rows that the cut has kept, so few a query
        docs, _ = written(docs, "cut")
        drop(docs.sparkSession, *used)
    if later:
        # these rows' offsets
        pairs = docs.select("query_id", "doc_id", F.explode("parts").alias("part")).select("query_id", "doc_id", "part.qi", "part.term", *(["part.block"] if index.blocks is not None else []))
        if at_once and pairs.count() <= BROADCAST_PLACES:
            pairs = F.broadcast(pairs)
        if index.blocks is not None:
            found = pruning.read(_looked_up(index.blocks, terms), pairs, with_offsets=True).drop("tf", "token_count").join(pairs, ["term", "block", "doc_id"])
        else:
            found = _looked_up(index.postings, terms).select("term", "doc_id", "offsets").join(pairs, ["term", "doc_id"])
        docs = docs.join(found.groupBy("query_id", "doc_id").agg(F.collect_list(F.struct("qi", "offsets")).alias("at")), ["query_id", "doc_id"])
    else:
        docs = docs.withColumn("at", F.col("parts"))
    places = F.array_sort(F.flatten(F.transform("at", lambda p: F.transform(p["offsets"], lambda o: F.struct(o.alias("off"), p["qi"].alias("qi"))))))
    near = docs.withColumn("places", places).withColumn("near", proximity(F.col("places")))
    full = near.select(
        "query_id",
        "doc_id",
        "base_score",
        boosted(F.col("base_score"), F.col("near.gap"), proximity_weight).alias("score"),
        F.col("near.gap").alias("gap"),
        F.coalesce("near.center", F.element_at("places", 1)["off"]).alias("match_offset"),
        F.transform("parts", lambda p: p["term"]).alias("terms"),
    )
    order = [F.desc("score"), F.desc("base_score")] if rerank else [F.desc("base_score"), F.desc("score")]
    placed = full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "doc_id")))
    placed = placed if k is None else placed.where(F.col("rank") <= k)
    return placed.select("query_id", "rank", "doc_id", "base_score", "score", "gap", "match_offset", "terms")


def _bodies(docs: DataFrame, rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The documents that may be among at most so many rows, and the rows."""
    if most > BROADCAST_ROWS:
        return docs, rows
    if most > PUSHED_DOCS:
        return docs, F.broadcast(rows)
    found = rows.collect()  # no more than PUSHED_DOCS
    here = docs.sparkSession.createDataFrame(found, rows.schema)
    wanted = F.lit(False)
    for i in {r["doc_id"] for r in found}:  # a long list would reach the scan as its smallest and largest value only
        wanted = wanted | (F.col("doc_id") == F.lit(i))
    return docs.where(wanted), F.broadcast(here)


def _shown(rows: DataFrame, docs: DataFrame, queries: DataFrame, k: int, window: int) -> DataFrame:
    """Ranked rows, at most k a query, with snippet, match_ranges (characters of the snippet) and matched_terms: bodies
    are read for these rows only."""
    docs, rows = _bodies(docs, rows, k * queries.count())
    terms = query_terms(queries)
    asked = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("qi", "term"))).alias("asked"))
    path = ["path"] if "path" in docs.columns else []
    full = docs.select("doc_id", *path, "body").join(rows, "doc_id").join(asked, "query_id")
    out = full.withColumn("snippet", fn.snippet(F.col("body"), F.col("match_offset"), window))
    out = out.withColumn("match_ranges", fn.match_ranges(F.col("snippet"), F.transform("asked", lambda a: a["term"])))
    return out.select("query_id", "rank", "doc_id", *path, "score", "match_offset", "snippet", "match_ranges", fn.matched_terms(F.col("match_ranges")).alias("matched_terms"))


def search(index: Index | None, query: str | DataFrame, *, k: int = RESULTS, window: int = WINDOW, **options) -> DataFrame:
    """The k best documents of each query with snippets: query_id, rank, doc_id, score, match_offset, snippet,
    match_ranges, matched_terms, and path if documents have one."""
    if index is None:
        raise RuntimeError("no index: build or load one first")
    queries = queries_of(index.postings.sparkSession, query)
    return _shown(ranked(index, queries, k=k, **options), index.documents, queries, k, window)


def _repeated(docs: DataFrame) -> bool:
    """Whether rows share a doc_id."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()


def raw_ranked(docs: DataFrame, query: str | DataFrame, *, k: int | None = RESULTS) -> DataFrame:
    """Without an index, by substrings: query_id, rank, doc_id, score (occurrences of all terms), match_offset (bytes
    before the first). The different terms of all queries are looked for together, in one look at each text. Each task
    hands on its k best of each query; without k, with repeated doc_ids or many terms, what is found meets the queries by a join."""
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    queries = queries_of(docs.sparkSession, query)
    asked = query_terms(queries).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    text = fn.as_text(F.col("body"))
    texts = docs.select("doc_id", text.alias("text")).withColumn("low", F.lower("text"))
    few = asked.limit(SCANNED_TERMS + 1).collect() if k and scan.can_order(docs.schema["doc_id"].dataType) else []
    if few and len(few) <= SCANNED_TERMS and k * len({r["query_id"] for r in few}) <= SCANNED_ROWS and not _repeated(docs):
        rows = scan.best(texts, few, queries.schema["query_id"].dataType, k)
    else:
        found = automaton.occurrences(texts.select("doc_id", "text"), asked.select("term").distinct(), low=F.lower("text"))
        rows = found.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("times")).cast("double").alias("score"), F.min("first").alias("match_offset"))
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    placed = placed if k is None else placed.where(F.col("rank") <= k)
    return placed.select("query_id", "rank", "doc_id", "score", "match_offset")


def raw_search(docs: DataFrame, query: str | DataFrame, *, k: int = RESULTS, window: int = WINDOW) -> DataFrame:
    """`raw_ranked` with snippets, like `search`."""
    queries = queries_of(docs.sparkSession, query)
    return _shown(raw_ranked(docs, queries, k=k), docs, queries, k, window)


def search_any(docs: DataFrame, query: str | DataFrame, index: Index | None = None, **options) -> DataFrame:
    """By the index if there is one, else by scanning."""
    return search(index, query, **options) if index is not None else raw_search(docs, query, **options)

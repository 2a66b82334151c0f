"""What becomes of results: bundles and prompts for language models, payloads, statistics of file types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn

SEPARATOR = "\n\n-----\n\n"


def _in_order(results: DataFrame, piece) -> DataFrame:
    """query_id and an array of pieces by rank; a query has as many rows as its search was asked for."""
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece")))).alias("pieces"))
    return lists.select("query_id", F.transform("pieces", lambda p: p["piece"]).alias("pieces"))


def bundle(results: DataFrame, separator: str = SEPARATOR, path_col: str = "path") -> DataFrame:
    """query_id and bundle: path, score and snippet of a query's results by rank, as one text."""
    piece = F.format_string("path: %s\nscore: %.3f\n\n%s", F.col(path_col).cast("string"), "score", "snippet")
    return _in_order(results, piece).select("query_id", F.array_join("pieces", separator).alias("bundle"))


def listing(results: DataFrame, path_col: str = "path") -> DataFrame:
    """query_id, rank and a printable line for each result."""
    return results.select("query_id", "rank", F.format_string("---\n%s\n%.3f\n%s", F.col(path_col).cast("string"), "score", "snippet").alias("line"))


def prompts(results: DataFrame, queries: DataFrame, template: str = "Answer the question from the context.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:") -> DataFrame:
    """query_id and prompt: the snippets of a query's results by rank, then the question."""
    head, tail = template.split("{context}")
    middle, end = tail.split("{question}")
    context = _in_order(results, F.col("snippet")).select("query_id", F.array_join("pieces", SEPARATOR).alias("context"))
    return context.join(queries, "query_id").select("query_id", F.concat(F.lit(head), "context", F.lit(middle), "query", F.lit(end)).alias("prompt"))


def answered(asked: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """query_id and answer, by a model that the caller provides (it must be usable in a task)."""

    def answer(batches):
        for b in batches:
            yield b.assign(answer=[model(p) for p in b["prompt"]])[["query_id", "answer"]]

    return asked.mapInPandas(answer, f"query_id {asked.schema['query_id'].dataType.simpleString()}, answer string")


def payloads(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and payload: a JSON object of the query and its results by rank, as a server returns it. Blank queries
    are an error of the caller's and have none."""
    fields = [c for c in ("path", "doc_id", "score", "snippet", "match_offset", "matched_terms", "match_ranges") if c in results.columns]
    lists = _in_order(results, F.struct(*fields))
    asked = queries.where(F.length(F.trim("query")) > 0)
    none = F.array().cast(lists.schema["pieces"].dataType)
    return asked.join(lists, "query_id", "left").select("query_id", F.to_json(F.struct("query", F.coalesce("pieces", none).alias("results"))).alias("payload"))


def file_type_stats(docs: DataFrame, path_col: str = "path", top: int | None = None) -> DataFrame:
    """label, n and share of all, for each extension; the most frequent first. Blank paths don't count."""
    labels = docs.where(F.length(F.trim(path_col)) > 0).select(fn.extension_label(F.col(path_col)).alias("label"))
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # of a row for each extension
    ordered = counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "label")
    return ordered if top is None else ordered.limit(top)

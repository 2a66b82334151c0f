"""Mixing sources to target weights by weighted fair queueing (native).

Every source is a queue of its documents in shuffled order, repeated up to `max_repeats` times. A document's virtual
finish time is the words of its source up to its end, divided by the source's target; the mix is what comes first in
the global order of those times, cut off at the total budget. At time 1 every source has reached its target.

No step puts a source into one task: a source of n documents is cut into about sqrt(n) slices of its shuffled order,
the slices' sums give each slice its start, and only within a slice rows are added up one by one. The global range
sort works the same way: finish times are dealt into equal ranges, the ranges' sums say which range holds the end of
the budget, and only that range has to be put in order row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, n_words, put_back, set_aside, shuffle_key, slice_of, written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of `sizes` (source, size): source, n_rows, source_size, source_rank, weight, target.

    Targets share `budget_share` of all sizes by weight; a target stops at `max_repeats` times its source's size and
    the excess is shared out again by weight until no target is above. With sources in the order of that stop by
    weight, those that stop come first, so the level at which the others settle follows from running sums.
    Sources: by code point, null last. Without rows or words: targets of 0.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")))
    stop = F.col("source_size") * F.lit(float(max_repeats))
    every = Window.partitionBy()
    in_order = Window.orderBy("stop_level", "source_rank")
    levels = (
        ranked.withColumn("stop", stop)
        .withColumn("stop_level", F.col("stop") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget_share)))
        .withColumn("stopped", F.sum("stop").over(in_order) - F.col("stop"))
        .withColumn("open_weight", F.sum("weight").over(every) - (F.sum("weight").over(in_order) - F.col("weight")))
        .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open_weight"))
        # the first source, in this order, that the level leaves below its stop settles the level
        .withColumn("settled", F.min(F.when(F.col("level") <= F.col("stop_level"), F.struct("stop_level", "source_rank", "level"))).over(every)["level"])
    )
    return levels.select("source", "n_rows", "source_size", "source_rank", "weight", F.least("stop", F.coalesce(F.col("weight") * F.col("settled"), F.col("stop"))).alias("target"))


def mix(docs: DataFrame, *, size_col: str | None = None, order_col: str | None = None, weights: Sequence[float] = WEIGHTS, budget_share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`docs` (doc_id, source, and text or the columns named) with size, source_size, target and copies.

    copies: how often the mix takes the document, 0 to `max_repeats`; copies * size are its words in the mix.
    A null text has size 0; documents of size 0 are never taken. The same rows give the same mix in any order and
    partitioning; of rows that are equal in doc_id, text and source any may be taken, which can't be told apart.
    Columns of those names are replaced; others are kept. An empty table gives an empty mix.
    """
    fixed = ["doc_id", "source"] + (["text"] if not (size_col and order_col) else [])
    outputs = ["size", "source_size", "target", "copies"]
    needed = docs if not size_col else docs.withColumn(measured := fresh(docs, "measured"), F.col(size_col))  # which may be one of the outputs
    aside, names = set_aside(needed, fixed, [*outputs, "taken"])
    out = _mix(aside, names[measured] if size_col else None, names[order_col] if order_col else None, weights, budget_share, max_repeats)
    return put_back(out, {c: n for c, n in names.items() if not size_col or c != measured}, *outputs)


def _mix(docs: DataFrame, size_col: str | None, order_col: str | None, weights: Sequence[float], budget_share: float, max_repeats: int) -> DataFrame:
    key, part, first, cum = (fresh(docs, x) for x in ("_key", "_slice", "_first", "_cum"))
    size = F.col(size_col).cast("long") if size_col else n_words(F.col("text"))
    order = F.col(order_col) if order_col else shuffle_key(F.col("doc_id"), F.col("text"))
    sized = docs.withColumns({"size": F.coalesce(size, F.lit(0)), key: order})

    targets = written(source_targets(sized.select("source", "size"), weights, budget_share, max_repeats), "mix-targets")
    budget, n_rows = targets.agg(F.sum("source_size") * F.lit(float(budget_share)), F.sum("n_rows")).first()
    facts = targets.select(F.col("source").alias("_of"), "source_size", "source_rank", "target", F.ceil(F.sqrt("n_rows")).alias("_slices"))
    placed = sized.join(facts, F.col("source").eqNullSafe(F.col("_of"))).withColumn(part, slice_of(F.col(key), F.col("_slices"))).drop("_of", "_slices")

    # words of the slices before, then within the slice
    sums = placed.groupBy("source_rank", part).agg(F.sum("size").alias("_words"))
    starts = sums.select("source_rank", part, (F.sum("_words").over(Window.partitionBy("source_rank").orderBy(part)) - F.col("_words")).alias(first))
    within = Window.partitionBy("source_rank", part).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = placed.withColumn(cum, F.sum("size").over(within)).join(starts, ["source_rank", part]).withColumn(cum, F.col(cum) + F.col(first))

    # the end of the budget in the global order of (finish time, source, key)
    def finish(turn: int):
        return (F.col(cum) + F.lit(turn) * F.col("source_size")) / F.col("target")

    times = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select("source_rank", F.col(key).alias("k"), "size", F.posexplode(F.array(*[finish(i) for i in range(max_repeats)])).alias("turn", "time"))
    # equal ranges of times below 2, where the budget ends unless a document is larger than a target; beyond, of their logarithms
    ranges = 2 * ceil(sqrt(max_repeats * (n_rows or 0) + 1))
    ranged = times.withColumn("range", F.floor(F.lit(ranges) * F.when(F.col("time") < 2, F.col("time")).otherwise(1 + F.log2("time"))))
    totals = ranged.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("range")))
    over = totals.where(F.col("upto") > F.lit(budget or 0.0)).orderBy("range").first()
    place = F.struct("time", "source_rank", "k")
    if over is None:
        last = None
    else:
        end = ranged.where(F.col("range") == over["range"]).withColumn("upto", F.sum("size").over(Window.orderBy("time", "source_rank", "k").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(over["upto"] - over["words"]))
        last = end.where(F.col("upto") > F.lit(budget)).orderBy("time", "source_rank", "k").select(place.alias("at")).first()["at"]

    def taken(turn: int):
        if last is None:
            return F.lit(1)
        here, there = F.struct(finish(turn).alias("time"), F.col("source_rank").alias("source_rank"), F.col(key).alias("k")), F.struct(F.lit(last["time"]).cast("double").alias("time"), F.lit(last["source_rank"]).cast("int").alias("source_rank"), F.lit(last["k"]).cast("long").alias("k"))
        return F.when(here < there, 1).otherwise(0)

    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((taken(i) for i in range(max_repeats)), F.lit(0))).otherwise(0)
    return queued.select(*docs.columns, "size", "source_size", "target", copies.alias("copies"))


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every row of `mix` as often as it is taken, in the columns named."""
    copy = fresh(mixed, "copy")
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy)).drop(copy)


def op10_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    docs = documents(spark, sf_dir)
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), shuffle_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-sizes")
    return mix(slim, size_col="words", order_col="key").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same by plain window functions, for DuckDB.
OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce('=' || doc_id, '-') || chr(31) || coalesce('=' || text, '-')), 1, 15))::BIGINT AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE source_rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS stop FROM src),
ordered AS (
  SELECT *, stop / weight AS stop_level, sum(source_size) OVER ()::DOUBLE AS budget,
         sum(stop) OVER w - stop AS stopped, sum(weight) OVER () - (sum(weight) OVER w - weight) AS open_weight
  FROM weighed WINDOW w AS (ORDER BY stop / weight, source_rank)),
settled AS (
  SELECT (budget - stopped) / open_weight AS level FROM ordered
  WHERE (budget - stopped) / open_weight <= stop_level ORDER BY stop_level, source_rank LIMIT 1),
targets AS (SELECT source, source_size, source_rank, least(stop, weight * (SELECT level FROM settled)) AS target FROM weighed),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.source_rank, s.k,
         sum(s.size) OVER (PARTITION BY t.source_rank ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT *, (cum + turn * source_size)::DOUBLE / target AS fin FROM queued, (VALUES (0), (1), (2)) v(turn) WHERE size > 0 AND target > 0),
sums AS (
  SELECT *, sum(size) OVER (ORDER BY fin, source_rank, k ROWS UNBOUNDED PRECEDING) AS upto FROM turns),
taken AS (
  SELECT source_rank, k, doc_id, count(*) AS copies FROM sums WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(t.copies, 0) * q.size)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.source_rank = t.source_rank AND q.k = t.k AND q.doc_id IS NOT DISTINCT FROM t.doc_id
"""

"""K-d tree sharding (native): boxes of the metadata space with nearly equal bytes.

All nodes of a level are split in the same jobs. A node's box is cut along its widest dimension at the weighted median
of its rows' sizes. The median is found by descent over the bits of a sort key: a histogram of 1,024 bins a node says
which bin holds the middle, and only that bin's rows are counted in the next, finer histogram; the descent ends as
soon as the bin holds next to nothing. Rows are never sorted or gathered: each task adds up its own histogram first,
and what is left of a node is one row of at most 1,024 bins.

The sort key is the dimension's value in 20 bits, then 10 bits of the text's hash, 10 of the row's and 10 of a row
number: equal values are thus cut in the order of texts, copies of a text stay together unless the middle falls among
them, and even a table of one row repeated can be cut into equal parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of, documents, dropped, fresh, put_back, set_aside, shuffle_key, slice_of, written

VALUE_BITS, TIE_BITS, STEP_BITS = 20, 30, 10
#: The middle bin of a split may hold this share of the node's bytes when the descent ends.
TOLERANCE = 0.0005
#: Levels after which the rows' shards are written, so that plans stay short.
LEVELS_A_TABLE = 4


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def place_of(column: Column, kind: str) -> Column:
    """A number in the order of the column: strings by their first six bytes, positive numbers by their logarithm."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.signum(column) * F.log2(F.abs(column.cast("double")) + 1)


def shards(rows: DataFrame, dimensions: Sequence[str], *, size_col: str, text_hash: str, row_hash: str, n_shards: int | None = None, target_bytes: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """`rows` with shard (0 to n_shards - 1, in the order of the tree's leaves) and slot (gapless from 0 in a shard).

    Give `n_shards`, or `target_bytes` for as many leaves as bring each to that size. text_hash and row_hash name
    columns of `shuffle_key`. Nulls in a dimension come before its values; a dimension of one value is never cut
    while another has two. An empty table gives no rows; with fewer rows than shards some shards stay empty. Repeated rows have
    shards and slots of their own. Columns named shard or slot are replaced, others kept.
    """
    sized = rows.withColumn(measured := fresh(rows, "measured"), F.col(size_col))  # which may be a dimension, or be replaced
    aside, names = set_aside(sized, (), ["shard", "slot"])
    out = _shards(aside, [names[d] for d in dimensions], names[measured], names[text_hash], names[row_hash], n_shards, target_bytes, tolerance)
    return put_back(out, {c: n for c, n in names.items() if c != measured}, "shard", "slot")


def _shards(rows: DataFrame, dimensions: Sequence[str], size_col: str, text_hash: str, row_hash: str, n_shards: int | None, target_bytes: int | None, tolerance: float) -> DataFrame:
    names = [fresh(rows, f"_place{i}") for i in range(len(dimensions))]
    tie, want = fresh(rows, "_tie"), fresh(rows, "_want")
    kinds = dict(rows.dtypes)
    spread = rows.agg(F.sum(size_col), *[f(place_of(F.col(d), kinds[d])) for d in dimensions for f in (F.min, F.max)]).first()
    if n_shards is None:
        n_shards = max(1, ceil((spread[0] or 0) / (target_bytes or 1)))

    def in_bits(i: int, d: str) -> Column:
        low, high = spread[1 + 2 * i], spread[2 + 2 * i]
        if low is None or high <= low:
            return F.when(F.col(d).isNull(), 0).otherwise(1).cast("long")
        top = (1 << VALUE_BITS) - 2
        return F.coalesce(F.floor((place_of(F.col(d), kinds[d]) - F.lit(low)) / F.lit(high - low) * F.lit(float(top))) + 1, F.lit(0)).cast("long")

    bits = F.shiftright(F.col(text_hash), 50) * (1 << 20) + F.shiftright(F.col(row_hash), 50) * (1 << 10) + F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << 10) - 1)
    placed = rows.withColumns({**{n: in_bits(i, d) for i, (n, d) in enumerate(zip(names, dimensions, strict=True))}, tie: bits, "shard": F.lit(0), want: F.lit(n_shards)})
    placed = written(placed, "shards-placed")

    level = 0
    while (1 << level) < n_shards:
        cuts = _cuts(placed, names, tie, want, size_col, tolerance)
        left = F.floor(F.col(want) / 2).cast("int")
        key = _key(names, tie, F.col("_dim"))
        goes_right = F.coalesce(key >= F.col("_cut"), F.lit(False))
        open_node = F.col(want) > 1
        nxt = placed.join(cuts, "shard", "left").withColumns(
            {
                "shard": F.when(open_node & goes_right, F.col("shard") + left).otherwise(F.col("shard")),
                want: F.when(~open_node, F.col(want)).when(goes_right, F.col(want) - left).otherwise(left),
            }
        )
        placed = nxt.drop("_dim", "_cut")
        level += 1
        if level % LEVELS_A_TABLE == 0:
            placed = written(placed, "shards-placed")
    return _with_slots(placed.drop(*names, tie, want), row_hash)


def _key(names: Sequence[str], tie: str, dim: Column) -> Column:
    value = F.element_at(F.array(*[F.col(n) for n in names]), dim + 1)
    return F.shiftleft(value, TIE_BITS) + F.col(tie)


def _cuts(placed: DataFrame, names: Sequence[str], tie: str, want: str, size_col: str, tolerance: float) -> DataFrame:
    """For every node that wants more than one shard: the dimension to cut, and the first key of its right part."""
    by_node = placed.where(F.col(want) > 1).groupBy("shard").agg(F.max(want).alias("_wants"), F.sum(size_col).alias("_bytes"), *[(F.max(n) - F.min(n)).alias(n) for n in names])
    widest = F.greatest(*[F.struct(F.col(n).alias("width"), F.lit(-i).alias("dim")) for i, n in enumerate(names)]) if len(names) > 1 else F.struct(F.col(names[0]).alias("width"), F.lit(0).alias("dim"))
    state = written(
        by_node.select("shard", (-widest["dim"]).alias("_dim"), (F.col("_bytes") * (F.floor(F.col("_wants") / 2) / F.col("_wants"))).alias("_aim"), F.col("_bytes"), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"), F.lit(0).cast("long").alias("_in"), F.lit(0).cast("long").alias("_cut")),
        "shards-state",
    )
    shift = VALUE_BITS + TIE_BITS
    while shift > 0:
        shift -= STEP_BITS
        fine = F.shiftright(_key(names, tie, F.col("_dim")), shift)
        inside = placed.join(state.select("shard", "_dim", "_prefix"), "shard").withColumn("_fine", fine).where(F.shiftright("_fine", STEP_BITS) == F.col("_prefix"))
        bins = inside.groupBy("shard", "_fine").agg(F.sum(size_col).alias("_w"))
        # at most 1,024 bins a node; the bin in which the running sum reaches the aim
        lists = bins.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("_fine", "_w"))).alias("_bins"))
        start = F.struct(F.col("_before").alias("upto"), F.lit(None).cast("long").alias("fine"), F.lit(0).cast("long").alias("w"))

        def walk(acc: Column, x: Column) -> Column:
            return F.when(acc["upto"] + acc["w"] >= F.col("_aim"), acc).otherwise(F.struct((acc["upto"] + acc["w"]).alias("upto"), x["_fine"].alias("fine"), x["_w"].alias("w")))

        found = state.join(lists, "shard").withColumn("_at", F.aggregate("_bins", start, walk))
        # the bin goes to the side that it fits better
        nearer = F.when(F.col("_aim") - F.col("_at.upto") > F.col("_at.w") / 2, 1).otherwise(0)
        state, old = (
            written(
                found.select("shard", "_dim", "_aim", "_bytes", F.col("_at.fine").alias("_prefix"), F.col("_at.upto").alias("_before"), F.col("_at.w").alias("_in"), F.shiftleft(F.col("_at.fine") + nearer, shift).alias("_cut")),
                "shards-state",
            ),
            state,
        )
        dropped(old)
        if state.where(F.col("_in") > F.col("_bytes") * F.lit(tolerance)).isEmpty():
            break
    return state.select("shard", "_dim", "_cut")


def _with_slots(rows: DataFrame, row_hash: str) -> DataFrame:
    """slot: the place in the shard's shuffled order. About sqrt(n) slices a shard, so that no task has a whole one."""
    rows = written(rows, "shards-rows")
    part = fresh(rows, "_slice")
    counts = rows.groupBy("shard").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_slices"))
    sliced = rows.join(written(counts, "shards-counts"), "shard").withColumn(part, slice_of(F.col(row_hash), F.col("_slices"))).drop("_slices")
    sums = sliced.groupBy("shard", part).agg(F.count(F.lit(1)).alias("_n"))
    starts = sums.select("shard", part, (F.sum("_n").over(Window.partitionBy("shard").orderBy(part)) - F.col("_n")).alias("_first"))
    within = Window.partitionBy("shard", part).orderBy(row_hash)
    return sliced.withColumn("slot", F.row_number().over(within) - 1).join(starts, ["shard", part]).withColumn("slot", (F.col("slot") + F.col("_first")).cast("long")).drop(part, "_first")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Dimensions of the tree: lang, source and the text's size. A null text has size 1 and the CRC of no bytes.
    """
    text = F.col("text")
    slim = documents(spark, sf_dir).select("doc_id", "lang", "source", text_bytes(text).alias("size"), crc32_of(text).alias("text_crc32"), shuffle_key(text).alias("text_hash"), shuffle_key(F.col("doc_id"), text).alias("row_hash"))
    out = shards(written(slim, "shards-slim"), ["lang", "source", "size"], size_col="size", text_hash="text_hash", row_hash="row_hash", n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Which blocks of postings a search has to read for its k best documents: the others are never unpacked.

A query's blocks tell their largest scores without being unpacked. The space of doc_ids is cut into cells at quantiles of the
query's blocks; what a document can score is at most the sum, over the query's terms, of the largest scores of blocks that reach
into its cell; of terms with few blocks, which reach far, the documents themselves tell their cells. The documents of the best few cells are scored first: the k-th of them is a score that the k best reach. A block
is read only if a document in it can reach that score, which is exact: a document that loses one of its blocks can't be among
the k best, and whatever is left of it stays below them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import unpacked

#: Cells of a query, at most.
CELLS = 256
#: Cells whose documents are scored first, for so many results each.
FIRST_CELLS, RESULTS_A_CELL = 4, 64
#: Sums in another order differ by rounding: bounds have this much room.
ROOM = 1e-9

Score = Callable[[Column, Column, Column], Column]


def in_cells(blocks: DataFrame, weights: DataFrame, score: Score, cells: int = CELLS) -> DataFrame:
    """query_id, term, block, cell and most: for each cell that has documents of a block of one of the query's terms, what they
    can score by it. weights: query_id, qi, term, idf; terms that a query repeats count each time.

    A term with more blocks than cells has blocks that span hardly more than a cell: they stand in all cells between their
    first and last document, which are at most as many more rows as there are cells, with their largest score. Those of other
    terms, and the short ones that end a term, are unpacked."""
    asked = weights.groupBy("query_id", "term").agg(F.sum("idf").alias("weight"))
    ends = blocks.select("term", "block", "first_doc", "last_doc", "tops")
    many = ends.groupBy("term").agg((F.count(F.lit(1)) > cells).alias("dense"))
    spans = ends.join(asked, "term").join(many, "term")
    quantiles = F.percentile_approx("first_doc", F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(8 * cells))
    grid = spans.groupBy("query_id").agg(F.array_sort(F.array_distinct(quantiles)).alias("grid"))

    def cell(doc: str) -> Column:
        return F.size(F.filter("grid", lambda g: g <= F.col(doc)))

    most = F.array_max(F.transform("tops", lambda t: score(t["tf"], t["token_count"], F.col("weight"))))
    wide = spans.where("dense and tops is not null").join(grid, "query_id").select("query_id", "term", "block", most.alias("most"), F.explode(F.sequence(cell("first_doc"), cell("last_doc"))).alias("cell"))
    near = blocks.join(many, "term").where("not dense or tops is null")
    rare = unpacked(near, with_offsets=False).join(asked, "term").join(grid, "query_id")
    near = rare.select("query_id", "term", "block", score(F.col("tf"), F.col("token_count"), F.col("weight")).alias("most"), cell("doc_id").alias("cell"))
    return wide.unionByName(near.groupBy("query_id", "term", "block", "cell").agg(F.max("most").alias("most")))


def promising(blocks: DataFrame, placed: DataFrame, weights: DataFrame, k: int, score: Score) -> DataFrame:
    """query_id, qi, term, block and idf of the blocks that hold the k best documents of each query. placed: `in_cells`,
    which is read several times."""
    of_term = placed.groupBy("query_id", "cell", "term").agg(F.max("most").alias("term_most"))
    of_cell = of_term.groupBy("query_id", "cell").agg(F.sum("term_most").alias("cell_most"))
    best = Window.partitionBy("query_id").orderBy(F.desc("cell_most"), "cell")  # a query has CELLS rows at most
    first = of_cell.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= max(FIRST_CELLS, -(-k // RESULTS_A_CELL))).select("query_id", "cell")
    sampled = placed.join(first, ["query_id", "cell"]).select("query_id", "term", "block").distinct()
    rows = read(blocks, sampled).join(sampled, ["term", "block"]).join(weights, ["query_id", "term"])
    sums = rows.groupBy("query_id", "doc_id").agg(F.sum(score(F.col("tf"), F.col("token_count"), F.col("idf"))).alias("sum"))
    place = Window.partitionBy("query_id").orderBy(F.desc("sum"))
    reached = sums.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k).groupBy("query_id").agg(F.min("sum").alias("reached"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    # a document of this block scores no more than this
    upper = placed.join(of_term, ["query_id", "cell", "term"]).join(of_cell, ["query_id", "cell"])
    upper = upper.groupBy("query_id", "term", "block").agg(F.max(F.col("cell_most") - F.col("term_most") + F.col("most")).alias("upper"))
    kept = upper.join(reached, "query_id", "left").where(F.col("reached").isNull() | (F.col("upper") * (1 + ROOM) >= F.col("reached") * (1 - ROOM)))
    return kept.select("query_id", "term", "block").join(weights, ["query_id", "term"])


def read(blocks: DataFrame, wanted: DataFrame, *, with_offsets: bool = False) -> DataFrame:
    """The postings of the blocks (term, block) that are wanted: each unpacked once."""
    return unpacked(blocks.join(wanted.select("term", "block").distinct(), ["term", "block"], "left_semi"), with_offsets=with_offsets)

"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample on the driver: the sample's neighbour graph is cut in balanced halves again and again (a
smoothed principal direction cut at its median, then swaps that lower the number of cut edges), and a small classifier
with one hidden layer learns to tell a vector's partition, and its neighbours', from the vector alone. Partitions that
hold too many rows are divided in the same way, each by a classifier of its own that is fitted in a task on a bounded
sample of the partition's rows, so that the number of leaves grows with the table. The number of leaves that a query tries
is the smallest that finds `recall` of the true neighbours of sample vectors that no first classifier was trained on.

Searching: every row goes to its most probable leaf; a query goes to its most probable ones, by the product of both
classifiers' probabilities, is compared there with all rows in blocks of bounded size, exactly and in double precision,
and the blocks' best are merged.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY_BITS, documents, shuffle_key, written

#: Vectors that the partitions and the classifier are learned from (every row is indexed and searched).
SAMPLE_ROWS = 8192
#: Sample vectors in a partition, and neighbours of each in the graph.
PART_ROWS, GRAPH_K = 128, 10
RECALL = 0.95
HIDDEN, EPOCHS, BATCH = 128, 12, 256
#: Rows above which a partition is divided, the sample it is divided by, and its classifier's hidden units.
LEAF_ROWS, LEAF_SAMPLE, LEAF_HIDDEN = 65_536, 4096, 32
#: Of the sample, one vector in so many is held out to find how many leaves a query tries.
HELD_OUT = 8
#: Rows and queries that are compared in one task.
ROW_BLOCK, QUERY_BLOCK = 8192, 8192


@dataclass(frozen=True)
class Router:
    """A classifier of partitions."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def log_p(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass(frozen=True)
class Tree:
    """The first classifier, and those of the partitions that are divided."""

    top: Router
    below: dict[int, Router]

    @property
    def first(self) -> np.ndarray:
        """The first leaf of each partition, and the number of leaves."""
        return np.r_[0, np.cumsum([self.below[p].parts if p in self.below else 1 for p in range(self.top.parts)])]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        part = self.top.log_p(x).argmax(1)
        leaf = self.first[part]
        for p, router in self.below.items():
            own = np.flatnonzero(part == p)
            if len(own):
                leaf[own] += router.log_p(x[own]).argmax(1)
        return leaf

    def order(self, x: np.ndarray) -> np.ndarray:
        """The leaves of each query, the most probable first."""
        p = self.top.log_p(x)
        leaves = [p[:, i : i + 1] + (self.below[i].log_p(x) if i in self.below else 0) for i in range(self.top.parts)]
        return np.argsort(-np.concatenate(leaves, 1), axis=1, kind="stable")


def _nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Places in y of the k nearest to each of x (own: x is y, and none is its own neighbour)."""
    out = np.empty((len(x), k), np.int64)
    norm = (y * y).sum(1)
    for at in range(0, len(x), 1024):
        d = norm - 2 * x[at : at + 1024] @ y.T
        if own:
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def partitioned(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A partition, 0 to parts - 1 (a power of two), of each node; sizes differ by one at most a cut."""
    label = np.zeros(len(x), np.int64)
    n = 1
    while n < parts:
        new = np.empty_like(label)
        for p in range(n):
            nodes = np.flatnonzero(label == p)
            new[nodes] = 2 * p + _halved(x[nodes], _within(graph, nodes, len(x)))
        label, n = new, 2 * n
    return label


def _within(graph: np.ndarray, nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges among some nodes, in their own numbering."""
    at = np.full(n, -1)
    at[nodes] = np.arange(len(nodes))
    to = at[graph[nodes]]
    a, j = np.nonzero(to >= 0)
    return a, to[a, j]


def _halved(x: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    n, (a, b) = len(x), edges
    a, b = np.r_[a, b], np.r_[b, a]
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    y = x - x.mean(0)
    axis = np.ones(x.shape[1])
    for _ in range(20):
        axis = y.T @ (y @ axis)
        axis /= np.linalg.norm(axis) or 1
    v = y @ axis
    for _ in range(15):
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], n) / degree
        v -= v.mean()
    side = np.zeros(n, np.int64)
    side[np.argsort(v, kind="stable")[n // 2 :]] = 1
    for _ in range(8):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2  # half of them, since swaps change the gains of others
        if not swaps:
            break
        side[left[:swaps]], side[right[:swaps]] = 1, 0
    return side


def fitted(sample: np.ndarray, hidden: int = HIDDEN) -> Router:
    """From sample vectors in a random order. Fewer than two partitions' worth: one partition."""
    sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
    n, d = sample.shape
    parts = 1 << max(0, int(np.log2(max(1, n // PART_ROWS))))
    mean, scale = (sample.mean(0), np.maximum(sample.std(0), 1e-12)) if n else (np.zeros(d), np.ones(d))
    if parts == 1:
        return Router(mean, scale, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = _nearest(sample, sample, GRAPH_K, own=True)
    label = partitioned(sample, graph, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), GRAPH_K), label[graph].ravel()), 0.5 / GRAPH_K)
    target[np.arange(n), label] += 0.5
    return _trained((sample - mean) / scale, target, mean, scale, hidden)


def probes_for(tree: Tree, trained: np.ndarray, held_out: np.ndarray, recall: float) -> int:
    """How many leaves have to be tried so that `recall` of the neighbours of the vectors held out are found."""
    if tree.first[-1] == 1 or len(trained) <= GRAPH_K or not len(held_out):
        return 1
    near = _nearest(held_out, trained, GRAPH_K, own=False)
    order = tree.order(held_out)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    found = np.sort(np.take_along_axis(place, tree.home(trained)[near], 1).ravel())
    return int(found[min(len(found) - 1, int(recall * len(found)))]) + 1


def _trained(x: np.ndarray, target: np.ndarray, mean: np.ndarray, scale: np.ndarray, hidden: int) -> Router:
    rng = np.random.default_rng(9)
    d, parts = x.shape[1], target.shape[1]
    p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (g @ p[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((x[rows].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[i] += 0.1 * (grad - m[i])
                v[i] += 0.001 * (grad * grad - v[i])
                p[i] -= 3e-3 * (1 - epoch / EPOCHS) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *p)


def takes_part(vector: Column) -> Column:
    """Not null or zero, without null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _routed(rows: DataFrame, tree, probes: int, counts: list[int] | None, k: int) -> DataFrame:
    """id, vector, and part, a leaf of the (broadcast) tree: the most probable one, or as many as a query tries (if
    `counts`, the rows of each leaf, are given), and so many more as hold k rows besides itself."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("part", T.IntegerType())])

    def route(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                x = _matrix(b.column(1))
                if counts is None:
                    at, part = np.arange(b.num_rows), tree.value.home(x)
                else:
                    order = tree.value.order(x)
                    before = np.cumsum(np.array(counts)[order], 1) - np.array(counts)[order]
                    at, j = np.nonzero((np.arange(order.shape[1]) < probes) | (before < k + 1))
                    part = order[at, j]
                yield pa.record_batch([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(part.astype(np.int32))], names=schema.names)

    return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(route, schema)


def _divided(home: DataFrame, sizes: dict[int, int]) -> dict[int, Router]:
    """The classifiers of the partitions of more than LEAF_ROWS rows: each fitted in a task, on about LEAF_SAMPLE of them.
    There are as many as the first one has partitions at most, some 40 KB each."""
    shares = [(p, LEAF_SAMPLE / n) for p, n in sizes.items() if n > LEAF_ROWS]
    if not shares:
        return {}

    def fit(rows: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(rows["key"]), kind="stable")
        router = fitted(_matrix(rows["vector"])[order], LEAF_HIDDEN)
        return pa.table([rows["part"].slice(0, 1), pa.array([pickle.dumps(router)], pa.binary())], names=["part", "router"])

    key = shuffle_key(F.col("id"))
    few = home.join(F.broadcast(home.sparkSession.createDataFrame(shares, "part int, share double")), "part")
    few = few.where(key < F.col("share") * float(1 << KEY_BITS)).select("part", "vector", key.alias("key"))
    return {r["part"]: pickle.loads(r["router"]) for r in few.groupBy("part").applyInArrow(fit, "part int, router binary").collect()}


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of c to each of q but itself, by exact distances, ties to the smaller id."""
    out = []
    norm = (c * c).sum(1)
    for at in range(0, len(q), 64):
        some = q[at : at + 64]
        d = norm - 2 * some @ c.T
        for i, row in enumerate(d):
            me = int(q_ids[at + i])
            row[c_ids == me] = np.inf
            limit = np.partition(row, k - 1)[k - 1] if k < len(row) else np.inf
            near = np.flatnonzero((row <= limit + 1e-9 * (norm.max() + some[i] @ some[i])) & (c_ids != me))
            exact = np.sqrt(((c[near] - some[i]) ** 2).sum(1))
            for j in np.lexsort((c_ids[near], exact))[:k]:
                out.append((me, int(c_ids[near[j]]), float(exact[j])))
    return out


def search(rows: DataFrame, queries: DataFrame, *, k: int = 10, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """For each of `queries` (id, vector) its k nearest of `rows` (id, vector): query_id, rank, vec_id, score.

    score: the Euclidean distance; ties go to the smaller id. A row is never a neighbour of the query with its id. Null
    ids, and vectors that don't take part (see `takes_part`) or that have another length than most of the sample, are
    left out on both sides; repeated query ids are searched once, repeated rows are neighbours once each. Fewer than k
    others: all of them. Empty tables give no rows.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    rows, queries = (x.select(F.col("id").cast("long").alias("id"), "vector").where(F.col("id").isNotNull() & takes_part(F.col("vector"))) for x in (rows, queries))
    drawn = [r["vector"] for r in rows.select("vector", shuffle_key(F.col("id")).alias("k")).orderBy("k").limit(sample_rows).collect()]
    lengths = [len(v) for v in drawn]
    d = max(set(lengths), key=lengths.count) if lengths else 1
    sample = np.array([v for v in drawn if len(v) == d], np.float64).reshape(-1, d)
    held_out = np.arange(len(sample)) % HELD_OUT == 0 if len(sample) > 2 * PART_ROWS else np.zeros(len(sample), bool)
    rows, queries = (x.where(F.size("vector") == d) for x in (rows, queries.dropDuplicates(["id"])))

    def sizes_of(x: DataFrame) -> dict[int, int]:
        return {r["part"]: r["count"] for r in x.groupBy("part").count().collect()}  # a row for each partition

    tree = Tree(fitted(sample[~held_out]), {})
    home = written(_routed(rows, spark.sparkContext.broadcast(tree), 1, None, k), "ann-rows")
    sizes = sizes_of(home)
    if below := _divided(home, sizes):
        tree = Tree(tree.top, below)
        home = written(_routed(home, spark.sparkContext.broadcast(tree), 1, None, k), "ann-rows")
        sizes = sizes_of(home)
    probes = probes_for(tree, sample[~held_out], sample[held_out], recall)
    counts = [sizes.get(p, 0) for p in range(int(tree.first[-1]))]
    asked = written(_routed(queries, spark.sparkContext.broadcast(tree), probes, counts, k), "ann-queries")
    asks = sizes_of(asked)
    blocks = [(p, max(1, -(-n // ROW_BLOCK)), max(1, -(-asks.get(p, 0) // QUERY_BLOCK))) for p, n in enumerate(counts)]
    dealing = spark.createDataFrame(blocks, "part int, row_blocks int, query_blocks int")

    def dealt(x: DataFrame, own: str, other: str) -> DataFrame:
        """Each row to one of its side's blocks, and to all blocks of the other side."""
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own)
        return x.join(F.broadcast(dealing), "part").select("part", "id", "vector", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            found = _best(np.asarray(right["id"]), _matrix(right["vector"]), np.asarray(left["id"]), _matrix(left["vector"]), k)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=schema.names)

    keys = ("part", "row_blocks", "query_blocks")
    near = dealt(home, "row_blocks", "query_blocks").groupBy(*keys).cogroup(dealt(asked, "query_blocks", "row_blocks").groupBy(*keys)).applyInArrow(compare, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings for those whose vec_id is divisible by 100: query_id, rank, vec_id, score."""
    rows = documents(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, rows.where("id % 100 = 0"))

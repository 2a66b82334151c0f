"""Compression of vectors into codes: each part of a vector is replaced by the index of its nearest codebook entry.

Entries are found by segment means: of a part and of an entry, the mean and the norm of what is left around it bound their
distance from below (Cauchy-Schwarz). Bounds by one segment filter first, then by two, by four and so on, halving segments; what
survives has its exact distance computed in integers. The filters leave some room for rounding, so they never drop a nearest entry
or one that is tied with it.

Codebooks are fitted by rounds of Lloyd's algorithm over all rows: tasks sum the parts of each entry, Spark adds the sums up, and
the codebooks (entries x dimensions numbers, whatever the rows) come back to the driver.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, written

#: Components up to this size have their distances in 64-bit integers; of larger ones Python's integers are used.
EXACT = 1 << 24
#: Vectors that are looked at together.
ROWS = 1024
#: A label that more than one in so many rows has is added up apart (there can't be more of them than this).
HOT = 1000


@dataclass(frozen=True)
class Codebooks:
    """entries: for each part an array of entries x components; components are floor(scale * x)."""

    entries: tuple[np.ndarray, ...]
    scale: float

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def segments(size: int) -> list[np.ndarray]:
    """Where the segments of a part begin, from one segment to ones of two components."""
    out, n = [], 1
    while n <= max(1, size // 2):
        out.append(np.unique(np.arange(n) * size // n))
        n *= 2
    return out


def _summary(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments' roots of sizes, means times these, and norms of what is left."""
    sizes = np.diff(np.r_[starts, x.shape[1]])
    mean = np.add.reduceat(x, starts, axis=1) / sizes
    left = x - np.repeat(mean, sizes, axis=1)
    return mean * np.sqrt(sizes), np.sqrt(np.add.reduceat(left * left, starts, axis=1))


def lower_bounds(x: np.ndarray, c: np.ndarray, starts: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """For pairs of a row of x and an entry of c: what their squared distance is at least, but for rounding."""
    out = np.zeros(len(row))
    for of_x, of_c in zip(_summary(x, starts), _summary(c, starts), strict=True):
        for j in range(len(starts)):
            apart = np.ascontiguousarray(of_x[:, j])[row] - np.ascontiguousarray(of_c[:, j])[entry]
            out += apart * apart
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry, the lowest of equal ones, and the exact squared distance. Integers; int64 unless
    they are so large that the squares don't fit, then Python's."""
    n, k = len(x), len(c)
    if x.dtype == object or c.dtype == object:  # beyond floating point: every entry survives
        row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    else:
        fx, fc = x.astype(np.float64), c.astype(np.float64)
        room = 1e-11 * x.shape[1] * max(1.0, np.abs(fx).max(initial=0), np.abs(fc).max(initial=0)) ** 2
        coarse, *finer = segments(x.shape[1])
        (mx, rx), (mc, rc) = _summary(fx, coarse), _summary(fc, coarse)
        low = np.square(mx - mc.T)
        low += np.square(rx - rc.T)
        # the exact distance of the entry with the smallest bound: nothing above it can be nearest
        most = ((x - c[low.argmin(axis=1)]) ** 2).sum(axis=1) + room
        row, entry = np.nonzero(low <= most[:, None])
        for starts in finer:
            stay = lower_bounds(fx, fc, starts, row, entry) <= most[row]
            row, entry = row[stay], entry[stay]
    d = sum((np.ascontiguousarray(x[:, j])[row] - np.ascontiguousarray(c[:, j])[entry]) ** 2 for j in range(x.shape[1]))
    cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(d, cut)
    hit = np.flatnonzero(d == least[row])
    one = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # pairs are in the order of rows and entries
    return entry[one], least


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), exact: int64, or Python integers where some are above EXACT."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0) <= EXACT:
        return scaled.astype(np.int64)
    return np.array([[math.floor(Fraction(float(v)) * Fraction(scale)) for v in r] for r in vectors], object)


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    """With zeros at the end, up to a multiple of parts: they add nothing to a distance."""
    return np.hstack([x, np.zeros((len(x), -x.shape[1] % parts), x.dtype)])


def _batches(batches, vector_at: int, dim: int):
    """Slices of batches, and the vectors of their rows, all of them whole."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            some = b.slice(i, ROWS)
            flat = pc.list_flatten(some.column(vector_at))
            yield some, np.asarray(flat).reshape(some.num_rows, dim)


def kept_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector isn't null or empty and holds finite components only."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & whole)


def _start(rows: DataFrame, id_col: str, vector_col: str, entries: int, parts: int, scale: float) -> tuple[int, Codebooks]:
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).select(vector_col).collect()  # `entries` rows
    dim = len(first[0][0]) if first else 0
    if not dim:
        return 0, Codebooks((), scale)
    x = _padded(integers(np.array([r[0] for r in first if len(r[0]) == dim], np.float64), scale), parts)
    return dim, Codebooks(tuple(np.split(x, parts, axis=1)), scale)


def _round(rows: DataFrame, vector_col: str, dim: int, books: Codebooks) -> Codebooks:
    """Each entry the floored mean of its parts; unused ones stay."""
    parts = len(books.entries)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    width = books.entries[0].shape[1]

    def sums(batches):
        entries = sent.value.entries
        count = np.zeros((parts, len(entries[0])), np.int64)
        total = np.zeros((parts, len(entries[0]), width), object if any(e.dtype == object for e in entries) else np.int64)
        for _, v in _batches(batches, 0, dim):
            x = _padded(integers(v, sent.value.scale), parts)
            if x.dtype == object:
                total = total.astype(object)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                at, _ = nearest(part, entries[p])
                count[p] += np.bincount(at, minlength=len(count[p]))
                np.add.at(total[p], at, part)
        p, e = np.nonzero(count)
        if len(p):
            values = pa.array([[str(s) for s in t] for t in total[p, e].tolist()], pa.list_(pa.string()))
            yield pa.record_batch([pa.array(p), pa.array(e), pa.array(count[p, e]), values], names=["p", "e", "n", "t"])

    found = rows.select(vector_col).mapInArrow(sums, "p long, e long, n long, t array<string>")
    added = found.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("t")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)])
    new = [e.copy() for e in books.entries]
    for r in added.collect():  # one row an entry
        means = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
        if max(map(abs, means)) > EXACT:
            new[r["p"]] = new[r["p"]].astype(object)
        new[r["p"]][r["e"]] = means
    return Codebooks(tuple(new), books.scale)


def fitted(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> tuple[int, Codebooks]:
    """The dimension and the codebooks of all rows with whole vectors, after so many rounds. They start as the parts of the
    vectors with the smallest ids (of equal ids the smaller vectors first, null ids last).

    Vectors of another length than the first one's take no part. A length that `parts` doesn't divide is filled up with
    zeros. Fewer rows than entries make fewer entries; none, none.
    """
    if parts < 1 or entries < 1 or entries > 256 or rounds < 0:
        raise ValueError("parts and entries (256 at most) must be positive, rounds not negative")
    whole = kept_vectors(rows.select(id_col, vector_col), vector_col)
    dim, books = _start(whole, id_col, vector_col, entries, parts, scale)
    for _ in range(rounds if dim else 0):
        books = _round(whole.where(F.size(vector_col) == dim), vector_col, dim, books)
    return dim, books


def encoded(rows: DataFrame, dim: int, books: Codebooks, vector_col: str = "embedding", *, code_col: str = "code", error_col: str = "error") -> DataFrame:
    """`rows` with whole vectors of that dimension, with code_col (two hex digits of an index for each part) and error_col
    (squared distances summed over parts; null where they don't fit a long). Columns of these names that are there already
    are replaced. Rows that are repeated have equal codes."""
    kept = [c for c in rows.columns if c.lower() not in (code_col.lower(), error_col.lower())]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(code_col, T.StringType()), T.StructField(error_col, T.LongType())])
    if not dim:
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    vector_at, parts = kept.index(vector_col), len(books.entries)

    def run(batches):
        entries = sent.value.entries
        digits = np.array([f"{i:02x}" for i in range(256)])
        for b, v in _batches(batches, vector_at, dim):
            x = _padded(integers(v, sent.value.scale), parts)
            found = [nearest(part, entries[p]) for p, part in enumerate(np.split(x, parts, axis=1))]
            code = digits[np.stack([at for at, _ in found], axis=1)]
            errors = [int(e) if int(e) < 1 << 63 else None for e in sum(d for _, d in found)]
            yield pa.record_batch([*b.columns, pa.array(["".join(c) for c in code.tolist()], pa.string()), pa.array(errors, pa.int64())], names=schema.names)

    return kept_vectors(rows.select(*kept), vector_col).where(F.size(vector_col) == dim).mapInArrow(run, schema)


def with_sums(rows: DataFrame, key_col: str, value_col: str, out_col: str) -> DataFrame:
    """`rows` (written) with the sum of a column over equal keys, nulls together. Sums are added up in the tasks before they
    are shuffled. Keys that more than one in HOT rows has, so HOT at most, are broadcast; rows of others are joined."""
    key, n, total = (fresh(rows, x) for x in ("sum_key", "sum_rows", out_col))
    sums = written(rows.groupBy(F.col(key_col).alias(key)).agg(F.sum(value_col).alias(total), F.count(F.lit(1)).alias(n)), "code-sums")
    every = sums.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(sums.where(F.col(n) * HOT > every).drop(n))
    same = F.col(key_col).eqNullSafe(F.col(key))
    rest = rows.join(hot.select(key), same, "left_anti").join(sums.where(F.col(n) * HOT <= every).drop(n), same)
    return rows.join(hot, same).unionByName(rest).drop(key).withColumnRenamed(total, out_col)


def op12_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with whole vectors: 16 parts, 64 entries, two rounds."""
    rows = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    dim, books = fitted(rows)
    coded = written(encoded(rows, dim, books).select("vec_id", "label", "code", "error"), "codes")
    out = with_sums(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same step by step: every distance of every part to every entry."""
    width = "len(v) // 16"
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS (SELECT r, p, v[p * ({width}) + 1 : (p + 1) * ({width})] AS x FROM kept, range({parts}) AS t(p))",
        f"book0 AS (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"far{i} AS (SELECT r, p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut JOIN book{i} USING (p))")
        steps.append(f"near{i} AS (SELECT r, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS m FROM far{i} GROUP BY r, p)")
        if i < rounds:
            steps.append(f"mean{i} AS (SELECT p, m.e AS e, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS y FROM near{i}, range(1, 1 + (SELECT max({width}) FROM kept)) AS t(i) GROUP BY ALL)")
            steps.append(f"book{i + 1} AS (SELECT p, e, coalesce(any_value(y.c), any_value(book{i}.c)) AS c FROM book{i} LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM mean{i} GROUP BY p, e) AS y USING (p, e) GROUP BY p, e)")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY r)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), digest"


OP12_SQL = _sql()

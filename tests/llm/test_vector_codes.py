import random

import duckdb
import numpy as np
import pytest

from tessera.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, sum_key int"


def vectors(n=500, dim=32, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(2000), [rng.choice([rng.gauss(0, 0.4), 0.25, -0.5]) for _ in range(dim)], rng.choice([7, 7, 7, None, *range(200)]), "clash", 1) for _ in range(n)]
    odd = [(5, None, 1, "c", 1), (6, [float("nan")] * dim, 1, "c", 1), (7, [float("inf"), *[0.0] * (dim - 1)], 1, "c", 1), (8, [None, *[0.0] * (dim - 1)], 1, "c", 1), (None, [0.5] * dim, None, "c", 1), (9, [0.0] * dim, 7, "c", 1)]
    return rows + odd + rows[:40]


def slow(rows, parts=16, entries=64, rounds=2):
    """Every distance to every entry, in Python's integers."""
    kept = [(i, [int(np.floor(256.0 * np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(r[1])[p] for r in order[:entries]] for p in range(parts)]

    def assigned(v):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])) for p, x in enumerate(cut(v))]

    for _ in range(rounds):
        members = [[[] for _ in books[0]] for _ in range(parts)]
        for _, v, _ in kept:
            for p, (_, e) in enumerate(assigned(v)):
                members[p][e].append(cut(v)[p])
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else books[p][e] for e, m in enumerate(members[p])] for p in range(parts)]
    out = [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), label) for i, v, label in kept for a in [assigned(v)]]
    return books, out


def test_like_slow(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    dim, books = vc.fitted(table)
    slow_books, want = slow(rows)
    assert dim == 32 and [e.tolist() for e in books.entries] == slow_books
    coded = vc.encoded(table, dim, books)
    assert coded.columns == ["vec_id", "embedding", "label", "sum_key", "code", "error"]
    assert sorted(map(str, ((r["vec_id"], r["code"], r["error"], r["label"]) for r in coded.collect()))) == sorted(map(str, want))


def test_query_equals_sql(spark, tmp_path):
    rows = vectors(300, 64, 4)
    spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = vc.op12_segment_mean_codes(spark, str(tmp_path)), con.sql(vc.OP12_SQL)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 48])
def test_nearest_is_exact_with_ties(width):
    rng = np.random.default_rng(width)
    x, c = rng.integers(-3, 4, (700, width)), rng.integers(-3, 4, (50, width))
    if width == 48:  # far from zero, close to each other
        x, c = x + (1 << 23), c + (1 << 23)
    at, d = vc.nearest(x, c)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_bounds_are_below_and_grow():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(60, 16)), rng.normal(size=(9, 16))
    row, entry = np.repeat(np.arange(60), 9), np.tile(np.arange(9), 60)
    d = ((x[row] - c[entry]) ** 2).sum(axis=1)
    before = np.zeros(len(d))
    for starts in vc.segments(16):
        low = vc.lower_bounds(x, c, starts, row, entry)
        assert (low <= d + 1e-9).all() and (low >= before - 1e-9).all()
        before = low


def test_odd_tables(spark):
    odd = [(1, [1e30, 0.0, 1.0], 1, "c", 1), (2, [-1e30, 0.0, 1.0], 1, "c", 1), (3, [1.0, 2.0], 1, "c", 1), (4, [0.5, 1.0, 1.0], 1, "c", 1), (5, [], 1, "c", 1)]
    table = spark.createDataFrame(odd, SCHEMA)
    dim, books = vc.fitted(table, parts=2, entries=2)
    out = {r["vec_id"]: r for r in vc.encoded(table, dim, books).collect()}
    assert dim == 3 and set(out) == {1, 2, 4} and all(len(r["code"]) == 4 for r in out.values())
    assert out[2]["code"][:2] == "01" and out[1]["code"][:2] == "00"
    nothing = table.where("vec_id < 0")
    assert vc.fitted(nothing)[0] == 0 and vc.encoded(nothing, *vc.fitted(nothing)).count() == 0
    few = table.where("vec_id = 4")
    assert vc.encoded(few, *vc.fitted(few, parts=3)).first()["code"] == "000000"

import random

import duckdb
import pytest

from tessera.llm.mixing import OP10_SQL, mix, op10_weighted_fair_mix, repeated


def targets(sizes, weights=(5.0, 2.0, 1.0), stop=3.0):
    """Shares by weight, the excess of those that stop shared out again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest = {}, set(names)
    while rest:
        left = sum(sizes.values()) - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > stop * sizes[s]}
        if not over:
            return out | share
        out |= {s: stop * sizes[s] for s in over}
        rest -= over
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_are_met(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 1]) for _ in range(rng.randint(0, 30))), rng.choice(["hot"] * 6 + ["a", "b", "tiny" if i % 40 == 0 else "c", None])) for i in range(1500)]
    rows += [(1500, None, "a"), (1501, "", "empty"), (None, "no id here", "b"), (3, "twice", "c"), (3, "twice", "c")]
    out = mix(table(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for s, n in sizes.items():
        own = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in own} == {n}
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - want[s]) <= 91 and max(r["copies"] for r in own) <= 3
    again = mix(table(spark, rows[::-1]).repartition(7)).collect()
    assert sorted((str(r["doc_id"]), r["copies"]) for r in again) == sorted((str(r["doc_id"]), r["copies"]) for r in out)


def test_repeated_rows_and_empty_tables(spark):
    out = mix(table(spark, [(1, "a b c", "x"), (2, "d", "y")]))
    assert repeated(out, ["doc_id"]).count() == sum(r["copies"] for r in out.collect())
    assert mix(table(spark, [])).collect() == []
    assert [r["copies"] for r in mix(table(spark, [(1, None, None), (2, " ", "s")])).collect()] == [0, 0]


FEW = {
    "one": [(1, "a b c", "x")],
    "one with words": [(1, "a b c", "x"), (2, "", "x"), (3, None, "y"), (4, " ", None)],
    "two": [(1, "a b c", "x"), (2, "d e", "y")],
    "three": [(1, "a b c", "x"), (2, "d e", "y"), (3, "f", None)],
    "each its own source": [(i, "w " * (1 + i % 4), f"s{i:02}") for i in range(12)],
    "one above all others": [(0, "w " * 900, "a"), *((i, "w", "a") for i in range(1, 40)), (99, "w w", "b")],
    "one source": [(i, "w " * (1 + i % 4), "a") for i in range(7)],
    "no words": [(1, "", "a"), (2, None, "b")],
}


@pytest.mark.parametrize("name", FEW)
def test_few_documents_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame([(*r, "en", 1) for r in FEW[name]], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op10_weighted_fair_mix(spark, str(tmp_path)).collect()))
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(own.sql(OP10_SQL).fetchall())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    # without any words the SQL has no level and no target
    assert all(abs((g[3] or 0) - (w[3] or 0)) < 1e-9 for g, w in zip(got, want, strict=True))
    assert sum(r[4] for r in got) <= sum(r[1] for r in got)

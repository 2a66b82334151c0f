import numpy as np

from tessera.llm import ann
from tessera.llm.ann import Tree, fitted, probes_for, search

SCHEMA = "id long, vector array<float>, rank string"


def brute(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in queries:
        d = np.sqrt(((x - np.array(v, np.float32)) ** 2).sum(1))
        out[i] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    return [(i, [float(c) for c in centres[rng.integers(20)] + 0.4 * rng.normal(size=d)]) for i in range(n)]


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_exact_scores(spark):
    rows = clustered(3000, 16, 1) + [(i, [0.5] * 16) for i in range(3000, 3400)]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    got, want = result(search(table, table.where("id % 50 = 0"))), brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert got.keys() == want.keys()
    assert fitted(np.array([v for _, v in rows])).parts > 4
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    scores = {(q, i): s for q, v in brute(rows, [r for r in rows if r[0] % 50 == 0], len(rows)).items() for i, s in v}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, v in got.items() for i, s in v)
    assert [i for i, _ in got[3000]] == list(range(3001, 3011))  # ties to the smaller id


def test_odd_rows_take_no_part(spark):
    good = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (100, [1.0, 0.0])]
    odd = [(200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [None, 1.0]), (700, [1.0]), (None, [1.0, 1.0]), (800, [])]
    table = spark.createDataFrame([(i, v, "") for i, v in good + odd], SCHEMA)
    assert result(search(table, table.where("id % 100 = 0"))) == brute(good, [good[0], good[3]], 10)
    assert search(table.where("false"), table).collect() == []
    assert search(table, table.where("false")).collect() == []


def test_leaves_grow_with_the_table(spark, monkeypatch):
    """Divided partitions keep the recall, and a query is compared with a falling share of the rows."""
    monkeypatch.setattr(ann, "LEAF_ROWS", 300)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 1024)
    shares = []
    for n in (2000, 12_000):
        rows = clustered(n, 8, 2)
        table = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
        asked = [r for r in rows if r[0] % 40 == 0]
        got, want = result(search(table, table.where("id % 40 = 0"), sample_rows=1024)), brute(rows, asked, 10)
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
        x = np.array([v for _, v in rows])
        sample = x[np.random.default_rng(3).permutation(n)[:1024]]
        top = fitted(sample[::2])
        part = top.log_p(x).argmax(1)
        tree = Tree(top, {p: fitted(x[part == p], 32) for p in range(top.parts) if (part == p).sum() > 300})
        probes, home = probes_for(tree, sample[::2], sample[1::2], 0.95), np.bincount(tree.home(x), minlength=tree.first[-1])
        shares.append(home[tree.order(x[:200])[:, :probes]].sum(1).mean() / n)
    assert shares[1] < 0.7 * shares[0]

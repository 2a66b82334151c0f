import random
import re

import pytest

from tessera.llm.jaccard import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, share):
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 11, 30, 60, 150]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
        rows.append(" ".join(passage + base))
    rows += [None, "", " \n ", "one", "ONE", "one two", "x" * 100_000, rows[0], rows[0].upper(), " ".join(vocabulary * 30)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize(("k", "share", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_equals_brute_force(spark, k, share, seed):
    rows = corpus(seed)
    rows += [rows[0], (None, rows[3][1]), (None, "alone in the world without an id"), (rows[5][0], "the same id but another text")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    out = [tuple(r) for r in near_duplicates(docs, k=k, share=share).collect()]
    assert sorted(out, key=str) == brute(rows, k, share)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    from tessera.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 2)
    rows = corpus(5)
    got = near_duplicates(spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA), k=3, share=70)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 70)

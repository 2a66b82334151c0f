import random

import pytest

from tessera.operators import index as ix
from tessera.operators import pruning, together
from tessera.operators import search as se

QUERIES = [(0, "w0 w1"), (1, "w0 w59 w58"), (2, "w5 w5 w0"), (3, "nothing"), (4, "w57"), (5, ""), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    made = [(rng.randrange(-(1 << 62), 1 << 62) if i % 3 else i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 80)))) for i in range(500)]
    made += [(10**15, "w0 " * 300), (10**15 + 1, None)] + [(10**16 + i, "same text w5") for i in range(200)]
    docs = ix.documents_of(spark.createDataFrame(made, "doc_id long, text string"))
    path = str(tmp_path_factory.mktemp("together"))
    ix.build_index(docs).save(path, with_documents=True)
    return ix.build_index(docs), ix.load_index(spark, path)


@pytest.mark.parametrize("k, bm25", [(3, True), (150, False)])
def test_scored_together_equals_row_by_row(spark, both, monkeypatch, k, bm25):
    """Equal ones at the cut, negative doc_ids and repeated terms included; postings aren't multiplied by the queries."""
    monkeypatch.setattr(se, "SHARED_POSTINGS", 1)
    monkeypatch.setattr(se, "SHARED_TIMES", 1)
    monkeypatch.setattr(together, "DOCUMENTS", 60)
    monkeypatch.setattr(together, "DEALT", 300)
    monkeypatch.setattr(pruning, "in_cells", None)
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    calls = []
    best = together.best
    monkeypatch.setattr(together, "best", lambda *a: calls.append(a) or best(*a))
    want = sorted(map(str, map(tuple, se.ranked(both[0], asked, k=k, use_bm25=bm25).collect())))
    got = sorted(map(str, map(tuple, se.ranked(both[1], asked, k=k, use_bm25=bm25).collect())))
    assert len(calls) == 1
    assert got == want

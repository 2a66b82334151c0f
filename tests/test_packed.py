import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.operators import packed, pruning
from tessera.operators import search as se


def test_numbers_come_back():
    rng = np.random.default_rng(1)
    for _ in range(40):
        count = rng.integers(0, 200, rng.integers(1, 60))
        width = rng.integers(0, 65, len(count))
        each = np.repeat(width, count)
        raw = rng.integers(0, 1 << 63, len(each), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, len(each)).astype(np.uint64)
        values = np.where(each > 0, raw >> (np.uint64(64) - np.maximum(each, 1).astype(np.uint64)), np.uint64(0))
        data, start = packed.pack(values, width, count)
        assert start[-1] == sum((w * c + 7) // 8 for w, c in zip(width.tolist(), count.tolist(), strict=True))
        assert (packed.unpack(data, width, count) == values).all()
        assert packed.bit_lengths(values).tolist() == [int(v).bit_length() for v in values.tolist()]


def texts(spark, n=700, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(rng.randrange(-(1 << 62), 1 << 62) if i % 3 else i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 80)))) for i in range(n)]
    rows += [(10**15, "w0 " * 300), (10**15 + 1, None), (10**15 + 2, ""), (10**15 + 3, "w1 w0")] + [(10**16 + i, "same text w5") for i in range(300)]
    return ix.documents_of(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    docs = texts(spark)
    path = str(tmp_path_factory.mktemp("packed"))
    ix.build_index(docs).save(path, with_documents=True)
    return ix.build_index(docs), ix.load_index(spark, path)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_postings_come_back(both):
    plain, loaded = both
    columns = ["term", "doc_id", "tf", "token_count", "offsets"]
    assert loaded.blocks is not None and rows(plain.postings.select(columns)) == rows(loaded.postings.select(columns))
    found = loaded.blocks.select("term", "n", "first_doc", "last_doc", "block")
    assert found.where("n > 128 or n < 1 or first_doc > last_doc").isEmpty() and found.count() == found.select("term", "block").distinct().count()
    assert loaded.blocks.where("term = 'w0' and n = 128").count() >= 2


def test_tops_beat_all_others(both):
    blocks = both[1].blocks.where("term in ('w0', 'w1', 'w5')")
    assert {(b["n"] == packed.BLOCK, b["tops"] is not None) for b in blocks.collect()} == {(True, True), (False, False)}
    for b in blocks.where("tops is not null").collect():
        mine = packed.unpacked(blocks.where((F.col("term") == b["term"]) & (F.col("block") == b["block"]))).select("tf", "token_count").collect()
        tops = [(t["tf"], t["token_count"]) for t in b["tops"]]
        assert set(tops) <= {tuple(m) for m in mine}
        assert all(any(t >= tf and n <= size for t, n in tops) for tf, size in mine)


QUERIES = [(0, "w0 w1"), (1, "w0 w59 w58"), (2, "w5 w5 w0"), (3, "nothing"), (4, "w57"), (5, ""), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("k, bm25, cells", [(1, True, 256), (7, False, 2), (400, True, 3)])
def test_pruned_equals_plain(spark, both, monkeypatch, k, bm25, cells):
    monkeypatch.setattr(pruning.in_cells, "__defaults__", (cells,))
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    plain, loaded = both
    want = rows(se.ranked(plain, asked, k=k, use_bm25=bm25))
    assert rows(se.ranked(loaded, asked, k=k, use_bm25=bm25, prune=True)) == want
    assert rows(se.ranked(loaded, asked, k=k, use_bm25=bm25, prune=False)) == want


@pytest.mark.parametrize("k1, b", [(0.0, 0.0), (1.2, 1.5)])
def test_pruned_by_other_weights(spark, both, k1, b):
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    want = rows(se.ranked(both[0], asked, k=3, k1=k1, b=b))
    assert rows(se.ranked(both[1], asked, k=3, k1=k1, b=b, prune=True)) == want


def test_fewer_postings_are_read(spark, tmp_path):
    """A rare word with a frequent one: most blocks of the frequent one can't hold one of the best documents."""
    rng = random.Random(1)
    made = [(i, "the " * rng.randint(1, 2) + "word " * rng.randint(3, 40) + ("hain hain" if i in (500, 501, 7000) else "")) for i in range(9000)]
    docs = ix.documents_of(spark.createDataFrame(made, "doc_id long, text string").repartition(8))
    ix.build_index(docs).save(str(tmp_path))
    loaded = ix.load_index(spark, str(tmp_path), docs)
    terms = se.query_terms(se.queries_of(spark, "the hain"))
    n, avg = loaded.size()
    weights = se.weighted(loaded, terms, n)
    blocks = loaded.blocks.where(F.col("term").isin("the", "hain"))
    score = se.scorer(True, 1.2, 0.75, avg)
    kept = pruning.promising(blocks, pruning.in_cells(blocks, weights, score), weights, 3, score)
    read = pruning.read(blocks, kept).count()
    assert read * 4 < packed.unpacked(blocks).count() == 9003
    assert rows(se.ranked(loaded, "the hain", k=3, prune=True)) == rows(se.ranked(ix.build_index(docs), "the hain", k=3))


def test_large_offsets_of_arrow():
    for kind in (pa.binary(), pa.large_binary()):
        raw, at = packed.bytes_of(pa.array([b"ab", b"", b"cde", b"f"], kind).slice(1, 2))
        assert raw.tobytes() == b"cde" and at.tolist() == [0, 0, 3]


def test_ids_that_are_no_numbers_stay_plain(spark, tmp_path):
    docs = spark.createDataFrame([("a", b"x y"), ("b", b"x")], "doc_id string, body binary")
    ix.build_index(docs).save(str(tmp_path), with_documents=True)
    loaded = ix.load_index(spark, str(tmp_path))
    assert loaded.blocks is None and [r["doc_id"] for r in se.ranked(loaded, "x", k=1).collect()] == ["b"]

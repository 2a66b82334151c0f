"""The queries over small tables with everything odd in them, and over empty ones."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = {
    "op1": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op2": ["doc_id", "n_shingles", "component_id"],
    "op3": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op4": ["doc_id", "held_out", "score", "predicted"],
    "op5": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
    "op7": ["doc_id", "n_lines", "n_dropped", "dropped_lines", "text_md5"],
    "op8": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op9": ["query_id", "rank", "vec_id", "score"],
    "op10": ["doc_id", "size", "source_size", "target", "taken"],
    "op11": ["page_id", "url", "text", "n_chars"],
    "op12": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op13": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


def rows():
    rng = random.Random(11)
    words = [f"wörd{i}" for i in range(80)]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", None]), rng.choice(["hot", "hot", "s", None]), 1) for i in range(150)]
    same = out[3][1]
    return [*out, *((i, same, "en", "hot", None) for i in range(150, 200)), (200, None, None, None, None), (201, "", "en", "s", 0), (202, "long text " * 20_000, "en", "s", 1), out[0], out[0], (None, "no id", "en", "s", 5)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    full, none = (str(tmp_path_factory.mktemp(n)) for n in ("full", "none"))
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 150, 2)] + [(1, None, None), (None, 1, 1)]
    vectors = [(i, [float((i * 37 + j * 11) % 17) for j in range(4)], 0) for i in range(300)] + [(400, None, 1), (500, [0.0] * 4, 1), (None, [1.0] * 4, 1)]
    pages = [(i, f"http://h{i % 3}.example.com/{i}", f"<nav>menu</nav><article><p>page {i}</p></article>") for i in range(30)] + [(30, None, None), (None, "", "")]
    for folder, some in ((full, slice(None)), (none, slice(0))):
        for name, values, schema in (("documents", rows(), DOCUMENTS), ("labels", labels, "doc_id long, quality int, toxic int"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int"), ("pages", pages, "page_id long, url string, html string")):
            spark.createDataFrame(values[some], schema).write.parquet(f"{folder}/{name}.parquet")
    return full, none


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tables, name):
    op = name.split("_")[0]
    run = registry.QUERIES[name]
    out = run(spark, tables[0])
    assert out.columns == COLUMNS[op]
    found = out.collect()
    assert run(spark, tables[1]).collect() == []
    if op == "op11":
        assert {r["page_id"]: r["text"] for r in found} == {**{i: f"page {i}" for i in range(30)}, 30: "", None: ""}
        return
    if op == "op12":
        assert sorted(str(r["vec_id"]) for r in found) == sorted([*map(str, range(300)), "500", "None"]) and {len(r["code"]) for r in found} == {32}
        return
    if op == "op9":
        assert {r["query_id"] for r in found} == {0, 100, 200} and len(found) == 30
        return
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows())
    text = {r[0]: r[1] or "" for r in rows()}
    for r in found:
        t = text[r["doc_id"]].encode()
        match op:
            case "op1":
                assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None) and 0 <= r["shard"] < 8
            case "op3":
                padded = t + bytes(-len(t) % 64 or (0 if t else 64))
                assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            case "op4":
                assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
            case "op5":
                assert r["decoded_sha256"] == hashlib.sha256(t).hexdigest()
            case "op6":
                assert r["n_tokens"] == len(t.split()) + 1 and r["score"] < 0
            case "op8":
                assert r["n_bytes"] == len(t) and r["over_limit"] == (r["n_tokens"] > 4096)
            case "op13":
                assert r["restored_sha256"] == hashlib.sha256(t).hexdigest() and r["n"] == len(text[r["doc_id"]])
            case "op10":
                assert r["size"] == len(t.split()) and 0 <= r["taken"] <= 3 * r["size"]
    if op == "op2":
        assert {r["component_id"] for r in found if 150 <= (r["doc_id"] or 0) < 200} == {3}

"""The pipeline against the same in plain Python (and the mix in DuckDB), over a small corpus with everything in it."""

import base64
import hashlib
import random
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken
from test_jaccard import brute as near_groups
from test_lines import brute as lines_of
from test_toxicity import slow_gains

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.mixing import OP10_SQL

RUDE = ["".join(random.Random(i).choices("bgkpuvwz", k=8)) for i in range(6)]


def corpus():
    rng = random.Random(12)
    plain = ["".join(rng.choice("aeinrstlo") for _ in range(rng.randint(2, 9))) for _ in range(700)]
    passage = " ".join(rng.choice(plain) for _ in range(55))
    rows = []
    for i in range(260):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 90))]
        for _ in range(14 * toxic):
            words[rng.randrange(len(words))] = rng.choice(RUDE)
        text = " ".join(words)
        if i % 7 == 3:
            text += "\n" + passage
        if i % 11 == 5:
            text = rows[-1][1]
        if i % 13 == 6:
            text = rows[-2][1].replace(" ", "  ", 2) + " " + rng.choice(plain)
        rows.append((i, text, "en", rng.choice(["hot", "hot", "a", "b", None]), len(text), int(any(w in text for w in RUDE))))
    return rows


def slow(rows, model):
    slow_model = [toxicity._features(Counter(g), n) for g, n in slow_gains([t for _, t, *_ in rows], model.ordinary, model.toxic)]
    odds = [sum(a * b for a, b in zip(x, model.weights, strict=True)) for x in slow_model]
    kept = [(d, t, s) for (d, t, _, s, _, _), o in zip(rows, odds, strict=True) if o < 0]
    # lines
    done = lines_of([(d, t) for d, t, _ in kept])
    kept = [(d, done[d][0], s) for d, t, s in kept if not (done[d][1] and not done[d][0].strip())]
    # near copies: the smallest doc_id of each group
    of = {d: c for d, _, c in near_groups([(d, t) for d, t, _ in kept], 5, 80)}
    kept = [(d, t, s) for d, t, s in kept if of[d] == d]
    # the mix, and each document as often as it is taken
    own = duckdb.connect()
    own.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    own.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    taken = {r[0]: r[4] // max(1, r[1]) for r in own.sql(OP10_SQL).fetchall()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t, _ in kept:
        ids = b"".join(i.to_bytes(4, "little") for i in encoding.encode_ordinary(t))
        out += [(d, ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * taken[d]
    return kept, out


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fitted(spark, str(tmp_path))
    kept, want = slow(rows, model)
    got = [(r["doc_id"], bytes(r["token_ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert 60 < len(kept) < 215 and len(want) > 60
    assert sorted(got) == sorted(want)

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import bpe
from tessera.llm.token_counts import LONG, model_file, token_counts

SCHEMA = "doc_id long, text string, n_tokens string, token_ids string"


def texts():
    rng = random.Random(3)
    pieces = ["the", " ", "  ", "\n", "Größe", "über", "日本語", "🙂", "<s>", "<|endoftext|>", "▁", "'s", "12345", "\u0000", "﻿", " ", "Ａ", "é", "x" * 40, ".,;!", "\t"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*out, None, "", " ", "a" * (3 * LONG), "ab " * 30_000, "né " * 5, "né " * 5, "no_blank_" * 9_000, "word\n" * 20_000 + "1"]


def table(spark, values):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(values)], SCHEMA)


def test_counts_are_the_library_s(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model_file())
    values = texts()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(table(spark, values)).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in enumerate(values)}


def test_ids_are_the_library_s_and_come_back(spark):
    encoding = bpe._encoding(bpe.rank_file(), public_tokenizers.PATTERN)
    values = texts()
    both = bpe.decoded(bpe.encoded(table(spark, values))).collect()
    assert len(both) == len(values)
    for r in both:
        text = values[r["doc_id"]] or ""
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    one = bpe.digests(table(spark, ["né"])).first()
    assert one["decoded_sha256"] == hashlib.sha256("né".encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 7, 50])
def test_parts_never_change_the_ids(size):
    encoding = bpe._encoding(bpe.rank_file(), public_tokenizers.PATTERN)
    for text in filter(None, texts()[:300]):
        cut = list(bpe.parts(text, size))
        assert "".join(cut) == text
        assert [i for p in cut for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_empty_tables(spark):
    none = table(spark, ["x"]).where("false")
    assert token_counts(none).collect() == [] and bpe.digests(none).collect() == []

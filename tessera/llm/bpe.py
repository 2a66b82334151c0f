"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, sliced

#: Texts above this many characters are encoded in parts.
PART_CHARS = 1 << 16
#: No match of the pattern goes on from a letter, digit or underscore to a blank or line feed, and none looks back.
SAFE = re.compile(r"(?<=\w)[ \n]")


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.splitlines()))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(ranks: bytes) -> list[bytes | None]:
    pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, filter(None, ranks.splitlines()))]
    out: list[bytes | None] = [None] * (max(pairs)[0] + 1)
    for i, b in pairs:
        out[i] = b
    return out


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about `size` characters, cut where no match of the pattern can span; else whole."""
    at = 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def rank_file(path: str | None = None) -> bytes:
    """The rank file's bytes (50k ranks are 0.8 MB), read on the driver and sent with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoder(text_at: int, names: list[str], ranks: bytes, pattern: str):
    """From batches of names but the last, and more, to batches of names: the last are the ids."""

    def encode(batches):
        enc = _encoding(ranks, pattern)
        for b in sliced(batches, text_at):
            ids = [b"".join(enc.encode_to_numpy(p, disallowed_special=()).astype("<u4").tobytes() for p in parts(t)) if t else b"" for t in b.column(text_at).to_pylist()]
            yield pa.record_batch([*(b.column(i) for i in range(len(names) - 1)), pa.array(ids, pa.binary())], names=names)

    return encode


def _decoder(ids_at: int, names: list[str], ranks: bytes):
    def decode(batches):
        of = _token_bytes(ranks)
        for b in sliced(batches, ids_at):
            raw = [b"".join(map(of.__getitem__, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in b.column(ids_at).to_pylist()]
            yield pa.record_batch([*(b.column(i) for i in range(len(names) - 1)), pa.array(raw, pa.binary())], names=names)

    return decode


def encoded(docs: DataFrame, text_col: str = "text", *, ranks: bytes | None = None, pattern: str | None = None, out_col: str = "token_ids") -> DataFrame:
    """`docs` with out_col (binary): the text's token ids as little-endian unsigned 32-bit integers.

    No special tokens: their strings in a text are ordinary text. Null and empty texts have no tokens (empty binary).
    Texts of any length; an out_col that is there already is replaced. Rows stay as they are, repeated ones too.
    """
    ranks, pattern = ranks or rank_file(), pattern or default_pattern()
    kept = [c for c in docs.columns if c != out_col]

    source = docs.select(*kept) if text_col in kept else docs.select(*kept, text_col)
    text_at = source.columns.index(text_col)
    names = [*kept, out_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])
    return source.mapInArrow(_encoder(text_at, names, ranks, pattern), schema)


def decoded(tokens: DataFrame, ids_col: str = "token_ids", *, ranks: bytes | None = None, out_col: str = "decoded") -> DataFrame:
    """`tokens` with out_col (binary): the raw bytes of the ids, which need not be whole characters. Null ids: empty.

    An id that the rank file doesn't have raises an error.
    """
    ranks = ranks or rank_file()
    kept = [c for c in tokens.columns if c != out_col]
    ids_at, names = kept.index(ids_col), [*kept, out_col]

    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])
    return tokens.mapInArrow(_decoder(ids_at, names, ranks), schema)


def round_trip(docs: DataFrame, *, ranks: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, token_ids and decoded: `encoded` and `decoded` in one go, in one Python worker a task."""
    ranks, pattern = ranks or rank_file(), pattern or default_pattern()
    encode, decode = _encoder(1, ["doc_id", "token_ids"], ranks, pattern), _decoder(1, ["doc_id", "token_ids", "decoded"], ranks)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(lambda batches: decode(encode(batches)), schema)


def digests(docs: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """What encoding and decoding give, per document: doc_id, token_ids if asked for, n_tokens, ids_sha256, decoded_sha256."""
    both = round_trip(docs)
    ids = ["token_ids"] if with_ids else []
    return both.select("doc_id", *ids, (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the 50k ranks and decoded again."""
    return digests(documents(spark, sf_dir))

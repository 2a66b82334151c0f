"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text, the lengths that they give short
windows, and thresholds.

Both sides share a dictionary trained on ordinary text, so that what is usual costs the same under either. Before it
stands, on the one side, a dictionary trained on more ordinary text and, on the other, one of the same size made of toxic
text: of the stretches of toxic documents that hold bytes in a row which ordinary text lacks, those of most documents
last. Stretches from one half of the documents count only if the dictionary made of the other half shortens them, so that
what sets a single document apart drops out. A toxic window is thus shorter under the toxic side, an ordinary one isn't.
Windows are words in a row of at least `WINDOW_BYTES` together, so that each compresses on its own and no word is cut. How
many bytes a window and a document must gain is calibrated on labelled documents that no dictionary has seen, and so are
the dictionaries' sizes.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_of, documents, shuffle_key, sliced

#: Labelled documents of each class that are looked at, two thirds for the dictionaries and the rest for the thresholds, and the
#: longest of them: a bounded sample that the driver can hold (the texts to be scored are never cut).
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 10_000
WINDOW_BYTES = 24
#: A block that saves less than a few bytes is stored as it is, which would hide small differences: the end of both
#: dictionaries stands before each window, so that every block compresses. No match begins in the last eight bytes of a
#: block: the beginning of the same stands after each window.
LEAD_BYTES, TAIL_BYTES = 24, 12
#: Sizes of the shared dictionary, and of the two that differ; the trainer's segments, and its shortest match.
SHARED_BYTES, OWN_BYTES = (4096, 8192), (512, 768, 1024)
SEGMENT_BYTES, MATCH_BYTES = 16, 6
#: Bytes in a row that ordinary texts must lack, and bytes that a stretch with them must gain.
NOVEL_BYTES, NOVEL_GAIN = 5, 2
#: Bytes in a row are usual if this share of ordinary documents has them: labels are not always right.
USUAL_SHARE = 0.015
#: Gains in bytes from which windows are counted.
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8)
#: Weight of toxic against ordinary documents when the thresholds are calibrated: ordinary ones shall be left alone.
TOXIC_WEIGHT = 0.35


def windows(text: str | None) -> list[bytes]:
    """The whole text, A-Z in lower case, as runs of words with one space between and around them."""
    out, run, size = [], [b""], 0
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
        run.append(w)
        size += len(w) + 1
        if size >= WINDOW_BYTES:
            run.append(b"")
            out.append(b" ".join(run))
            run, size = [b""], 0
    if size:
        run.append(b"")
        out.append(b" ".join(run))
    return out


@dataclass(frozen=True)
class Model:
    """Raw contents of both dictionaries, and the weights of `_features`, calibrated on documents that they haven't seen."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def score(self, texts: list[str | None]) -> list[float]:
        x = np.array([_features(*g) for g in gains(texts, self.ordinary, self.toxic)], float).reshape(len(texts), -1)
        return (1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))).tolist()


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    import zstandard as z

    # short matches count, and literals of windows this short are stored as they are
    how = z.ZstdCompressionParameters.from_level(9, strategy=z.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=15, chain_log=15, search_log=6, write_content_size=0, write_dict_id=0)
    return [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress if d else None for d in (ordinary, toxic)]


def gains(texts: list[str | None], ordinary: bytes, toxic: bytes) -> list[tuple[Counter, int]]:
    """For each text, how many windows are so many bytes shorter under the toxic dictionary (only gains above 0), and how
    many windows it has."""
    a, b = _compressors(ordinary, toxic)
    if a is None or b is None:
        return [(Counter(), 0) for _ in texts]
    lead, tail = _edges(ordinary)
    cut = [windows(t) for t in texts]
    return [(Counter(g for w in ws if (g := len(a(x := lead + w + tail)) - len(b(x))) > 0), len(ws)) for ws in cut]


def _edges(side: bytes) -> tuple[bytes, bytes]:
    """What stands before and after each window."""
    lead = side[-LEAD_BYTES:]
    return lead, lead[:TAIL_BYTES]


def _features(gain: Counter, n: int) -> list[float]:
    over = [math.log1p(sum(c for g, c in gain.items() if g >= t)) for t in THRESHOLDS]
    return [1.0, min(max(gain, default=0), 16) / 4, *over, math.log1p(n) / 4]


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary; of samples too few for its trainer, the samples themselves."""
    import zstandard as z

    try:
        raw = z.train_dictionary(size + 600, samples, k=SEGMENT_BYTES, d=MATCH_BYTES).as_bytes()
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]
    return raw[-min(size, max(0, len(raw) - 300)) :]  # it stands at the end, after tables of up to some 300 bytes


def _made(found: list[list[bytes]], size: int) -> bytes:
    """A dictionary of the stretches of documents, those of most documents last and so nearest to what is compressed."""
    documents = Counter(x for xs in found for x in set(xs))
    return b"".join(x for x, _ in sorted(documents.items(), key=lambda x: (x[1], x[0])))[-size:]


def _grams(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text as its windows write it, and the runs of NOVEL_BYTES within a word and the blanks around it: where they
    begin, and as numbers."""
    raw = b" ".join([b"", *text.encode("utf-8", "surrogatepass").lower().split(), b""])
    code = np.frombuffer(raw, np.uint8).astype(np.int64)
    n = max(0, len(code) - NOVEL_BYTES + 1)
    inner = sum((code[i : i + n] == 32 for i in range(1, NOVEL_BYTES - 1)), np.zeros(n, np.int64))
    at = np.flatnonzero(inner == 0)
    return raw, at, sum((code[at + i] << 8 * i for i in range(NOVEL_BYTES)), np.zeros(len(at), np.int64))


def _novel(text: str, usual: np.ndarray) -> list[bytes]:
    """The words of a text that hold bytes in a row which aren't among the usual ones (in order), with their blanks."""
    raw, at, grams = _grams(text)
    place = np.minimum(np.searchsorted(usual, grams), len(usual) - 1)
    starts = sorted({raw.rfind(b" ", 0, i + 1) for i in at[usual[place] != grams].tolist()})
    return [raw[i : raw.find(b" ", i + 1) + 1] for i in starts]


def _of_both_halves(found: list[list[bytes]], shared: bytes, other: bytes, size: int) -> list[list[bytes]]:
    """Of the stretches of each half of the documents, those that the dictionary made of the other half shortens."""
    out: list[list[bytes]] = []
    half = len(found) // 2
    for own, rest in ((found[:half], found[half:]), (found[half:], found[:half])):
        a, b = _compressors(*_sides(other, _made(rest, size), shared))
        lead, tail = _edges(shared)
        out += [[x for x in xs if a and b and len(a(lead + x + tail)) - len(b(lead + x + tail)) >= NOVEL_GAIN] for xs in own]
    return out


def _sides(other: bytes, extra: bytes, shared: bytes) -> tuple[bytes, bytes]:
    """Both before what they share, of equal sizes, since zstandard's way of searching depends on the dictionary's."""
    n = min(len(other), len(extra))
    return other[len(other) - n :] + shared, extra[len(extra) - n :] + shared


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Newton's method on the penalised log-likelihood, and the loss at its end; without anything to go by, documents count
    as ordinary."""
    weight = np.where(y == 1, TOXIC_WEIGHT / max(y.sum(), 1), 1 / max((1 - y).sum(), 1)) * len(y)
    beta = np.zeros(x.shape[1])
    penalty = np.r_[1e-3, np.full(x.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        beta += np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return beta, float(-(weight * np.log(np.where(y == 1, p, 1 - p))).sum())


def train(rows: list[tuple[str, int]]) -> Model:
    """From labelled texts in a random order. Without texts of both classes: a model that scores all texts alike."""
    toxic, clean = ([t for t, y in rows if y == label and t] for label in (1, 0))
    toxic, clean = _unlike(toxic), _unlike(clean)
    if len(toxic) < 2 or len(clean) < 2:
        return Model(b"", b"", (-2.0, *[0.0] * (len(THRESHOLDS) + 2)))
    cut = [max(1, len(x) * 2 // 3) for x in (toxic, clean)]
    plain = [w for t in clean[: cut[1]] for w in windows(t)]
    random.Random(4).shuffle(plain)
    grams, documents = np.unique(np.concatenate([np.unique(_grams(t)[2]) for t in clean[: cut[1]]]), return_counts=True)
    usual = grams[documents >= max(1, USUAL_SHARE * cut[1])]
    found = [_novel(t, usual) if len(usual) else windows(t) for t in toxic[: cut[0]]]
    rest = [(t, 1) for t in toxic[cut[0] :]] + [(t, 0) for t in clean[cut[1] :]]
    y = np.array([label for _, label in rest])
    best: tuple[float, Model] | None = None
    for shared_bytes in SHARED_BYTES:
        shared = _trained(plain[::2], shared_bytes)
        for size in OWN_BYTES:
            other = _trained(plain[1::2], size)
            sides = _sides(other, _made(_of_both_halves(found, shared, other, size), size), shared)
            weights, loss = _fit_logistic(np.array([_features(*g) for g in gains([t for t, _ in rest], *sides)]), y)
            if best is None or loss < best[0]:
                best = loss, Model(*sides, tuple(map(float, weights)))
    return best[1]


def _unlike(texts: list[str]) -> list[str]:
    """The texts without those that share more than a fifth of their runs of three words with earlier ones."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.lower().split()
        runs = {hash(x) for x in zip(w, w[1:], w[2:], strict=False)} or {hash(t)}
        if len(runs & seen) <= 0.2 * len(runs):
            out.append(t)
        seen |= runs
    return out


def training_rows(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """Up to n labelled texts of each class, of 1 to SAMPLE_BYTES bytes: of the first 2 n labels of the class in the
    order of a hash of doc_id. Labels of 0 and 1 only, and no document of the held-out fifth."""
    own = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").where(crc32_of(F.col("doc_id")) % 5 != 0).dropDuplicates(["doc_id"])
    key = shuffle_key(F.col("doc_id"))
    drawn = [(r["doc_id"], r["k"], label) for label in (0, 1) for r in own.where(F.col("toxic") == label).select("doc_id", key.alias("k")).orderBy("k", "doc_id").limit(2 * n).collect()]
    few = docs.sparkSession.createDataFrame(drawn, T.StructType([labels.schema["doc_id"], T.StructField("k", T.LongType()), T.StructField("toxic", T.IntegerType())]))
    # at most 4 n rows of three numbers are broadcast, and their texts collected
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, SAMPLE_BYTES)).join(F.broadcast(few), "doc_id").select("k", "text", "toxic").collect()
    return _first(sorted(texts), n)


def _first(rows: list, n: int) -> list[tuple[str, int]]:
    """The first n rows of each class, in their order."""
    seen: Counter = Counter()
    out = []
    for _, text, label in rows:
        seen[label] += 1
        if seen[label] <= n:
            out.append((text, label))
    return out


def scored(docs: DataFrame, model: Model, text_col: str = "text", *, out_col: str = "toxicity") -> DataFrame:
    """`docs` with out_col (double, 0 to 1): how likely the whole text is toxic.

    Null and empty texts have no windows and get the score of a text without gains. An out_col that is there already is
    replaced; rows stay as they are.
    """
    kept = [c for c in docs.columns if c != out_col]

    def score(batches):
        for b in sliced(batches, text_at):
            p = model.score(b.column(text_at).to_pylist())
            yield pa.record_batch([*(b.column(i) for i in range(len(kept))), pa.array(p, pa.float64())], names=names)

    source = docs.select(*kept) if text_col in kept else docs.select(*kept, text_col)
    text_at, names = source.columns.index(text_col), [*kept, out_col]
    return source.mapInArrow(score, T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, T.DoubleType())]))


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labelled documents in a folder."""
    return train(training_rows(documents(spark, sf_dir), documents(spark, sf_dir, "labels")))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scored(docs, fitted(spark, sf_dir), out_col="score")
    return out.select("doc_id", (crc32_of(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

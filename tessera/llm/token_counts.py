"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged numpy arrays.

A batch's new pre-tokens lie one after the other in flat arrays: a symbol per entry, and the rank of the pair that an
entry makes with the next one. A round finds every sequence's lowest rank (leftmost first) with one segmented minimum,
and merges that pair in all sequences at once. Sequences without a pair that merges leave; their symbols are counted.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, sliced

NEVER = np.int64(1) << 40
#: Pre-tokens above this length are cut first where no piece holds both neighbours, so that no merge goes across. What is
#: still longer takes as many rounds as it has merges, and is merged by a heap in place of them, in n log n steps.
LONG = 512
#: Counts of so many pre-tokens are kept by a Python worker; beyond, it starts anew.
KNOWN = 500_000
#: Characters of a long text that are looked at together.
PART_CHARS = 1 << 20
SPACE = "▁"


class Merges:
    """The merges of a model: which symbol each character is, and the rank and result of each pair of symbols."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.GetPieceSize()
        if not any(sp.IsByte(i) for i in range(n)) or sp.encode(" a  b ", out_type=str) and sp.decode(sp.encode("Ａ  b ")) != "Ａ  b ":
            raise NotImplementedError("models with byte fallback and without normalisation only")
        ids = {sp.IdToPiece(i): i for i in range(n) if not (sp.IsByte(i) or sp.IsControl(i) or sp.IsUnknown(i))}
        order = np.argsort([-sp.GetScore(i) for i in range(n)], kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.n = n
        self.char = np.full(0x110000, -1, np.int64)
        pairs = []
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
            pairs += [(ids[piece[:k]] * n + ids[piece[k:]], rank[i], i) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        # a piece never goes on after a character that stands in no piece, nor from another character to a space
        self.splits = all(SPACE not in p.lstrip(SPACE) for p in ids)
        self.breaks = not any("\n" in p for p in ids)
        self.words = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.breaks else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if self.splits else re.compile(r"(?s).+")
        self.known: dict[str, int] = {}
        self.inside = np.unique(np.array([ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.pairs: dict[int, tuple[int, int]] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair (NEVER and -1 if it doesn't merge)."""
        key = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), np.where(hit, self.made[at], -1)

    def counts(self, words: list[str]) -> list[int]:
        """Symbols of each word after all merges; a character without a piece counts its UTF-8 bytes."""
        out = np.zeros(len(words), np.int64)
        short = [(i, w) for i, word in enumerate(words) for w in (self.cut(word) if len(word) > LONG else (word,))]
        for i, w in short:
            if len(w) > LONG:
                out[i] += self.count_long(w)
        short = [(i, w) for i, w in short if len(w) <= LONG]
        if short:
            np.add.at(out, [i for i, _ in short], self.count_short([w for _, w in short]))
        return out.tolist()

    def cut(self, word: str) -> list[str]:
        """A long word cut where no piece holds both neighbours."""
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)
        cuts = [0, *(np.flatnonzero(self.inside[at] != pair) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def count_short(self, words: list[str]) -> np.ndarray:
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char[code]
        row = np.repeat(np.arange(len(words)), lens)
        lost = np.where(sym < 0, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        extra = np.bincount(row, lost - 1, len(words)).astype(np.int64)  # bytes beyond one symbol
        out = extra.copy()
        rank = np.full(len(sym), NEVER)
        made = np.full(len(sym), -1, np.int64)
        inner = np.flatnonzero(row[:-1] == row[1:])
        rank[inner], made[inner] = self.look_up(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lens = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NEVER
            if done.any():
                out[row[starts[done]]] += lens[done]
                keep = np.repeat(~done, lens)
                sym, row, rank, made = sym[keep], row[keep], rank[keep], made[keep]
                lens, least = lens[~done], least[~done]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, lens))
            at = hits[np.r_[True, row[hits[1:]] != row[hits[:-1]]]]  # the leftmost of each sequence
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # its place once the entries to the right of earlier merges are gone
            sym, row, rank, made = sym[keep], row[keep], rank[keep], made[keep]
            for i in (moved, moved - 1):
                ok = (i >= 0) & (i + 1 < len(sym))
                ok[ok] = row[i[ok]] == row[i[ok] + 1]
                j = i[ok]
                rank[j], made[j] = self.look_up(sym[j], sym[j + 1])
                last = i[(~ok) & (i >= 0)] if i is moved else i[:0]
                rank[last] = NEVER
        return out

    def count_long(self, word: str) -> int:
        sym = self.char[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n, nxt, prv = len(sym), [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)]
        alive, heap = [True] * n, []
        rank, made = self.look_up(np.array(sym[:-1]), np.array(sym[1:]))
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        pair = self.pairs
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(rank.tolist()) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = pair[a * self.n + b][1], False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and sym[x] >= 0 and sym[y] >= 0 and (p := pair.get(sym[x] * self.n + sym[y])):
                    heapq.heappush(heap, (p[0], x, sym[x], sym[y]))
        return sum(1 if s >= 0 else len(c.encode("utf-8", "surrogatepass")) for s, c, on in zip(sym, word, alive, strict=True) if on)

    def of_texts(self, texts: Iterable[str | None]) -> list[int]:
        out = []
        for group in _groups(texts):
            split = [self.words.findall(p) for p in group]
            new = list({w for ws in split for w in ws if w not in self.known})
            if len(self.known) + len(new) > KNOWN:
                new = list({w for ws in split for w in ws})
                self.known = {}
            self.known.update(zip(new, self.counts(new), strict=True))
            count = self.known.__getitem__
            out += [sum(map(count, ws)) for ws in split]
        return out


def _groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Escaped texts, some megabytes at a time."""
    group, size = [], 0
    for t in texts:
        group.append(SPACE + t.replace(" ", SPACE) if t else "")
        size += len(group[-1])
        if size > PART_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def _merges(model: bytes) -> Merges:
    return Merges(model)


def model_file(path: str | None = None) -> bytes:
    """The model's bytes (0.5 MB for 32k pieces), read on the driver and sent with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, text_col: str = "text", *, model: bytes | None = None, out_col: str = "n_tokens") -> DataFrame:
    """`docs` with out_col (long): tokens of the whole text as sentencepiece's encode gives them by default.

    Null and empty texts: 0. Strings like "<s>" in a text are ordinary text. Rows stay as they are; an out_col that is
    there already is replaced.
    """
    model = model or model_file()
    kept = [c for c in docs.columns if c != out_col]

    def count(batches):
        merges = _merges(model)
        for b in sliced(batches, text_at):
            n = merges.of_texts(b.column(text_at).to_pylist())
            yield pa.record_batch([*(b.column(i) for i in range(len(kept))), pa.array(n, pa.int64())], names=names)

    source = docs.select(*kept) if text_col in kept else docs.select(*kept, text_col)
    text_at, names = source.columns.index(text_col), [*kept, out_col]
    return source.mapInArrow(count, T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, T.LongType())]))


def op8_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_bytes, n_tokens, over_limit (above 4,096 tokens)."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))

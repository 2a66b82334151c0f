"""Language-model scoring by online logistic context mixing, in total bits per text and per byte.

A byte is coded as the bits of its Huffman code, of which there is one for each byte before it, so that about three and a
half bits of a byte of prose have to be predicted. Each bit has several predictors, one per hashed context: the two and three bytes before it and the word so
far. What they predict comes from counts of (context, byte) over all training documents; where a context wasn't seen,
the shorter one before it predicts in its place. A text's own mixer weighs their logits, with a set of weights chosen by
a gate (how far the word has come), and a last stage corrects the mixed logit by how far off such logits have been.
Weights and corrections start from fixed values in every text and are refined after each block of it, from 64 bytes to
4,096: nothing of a block is used before the block is coded, so the bits add up to a code length. Texts of a batch are
coded together, block by block; a long one goes through in parts, so that memory doesn't depend on its length.

All counts grow with the corpus: those of contexts, which are told apart by 56 bits of hash and last byte, and those of words,
by which the unigram base score is computed. They are counted in sorted runs of bounded size, which are packed into
binary columns, shuffled by ranges of hashes and merged there. A bounded number of the most frequent contexts and words
goes to every task; the others are asked for by the texts that have them, range by range, and come back to blocks of
texts, so that no task ever holds more than a range of the counts or what a block of texts needs of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc32_of, documents, sliced, written
from .shingles import _BYTE, _WHITE, mixed, powers, word_hashes

#: Kinds of contexts: 1 two bytes, 2 three bytes, 3 the word so far; kind 0 counts words.
KINDS = (1, 2, 3)
#: The bytes of a word that its context looks back.
WORD_BYTES = 32
#: By kind, occurrences in the training texts from which a context predicts.
LEAST_SEEN = {1: 1, 2: 2, 3: 2}
#: The most frequent contexts of each kind, whose logits go to every task (255 bytes each).
TOP_CONTEXTS = 131_072
#: The most frequent words, whose counts go to every task (16 bytes each).
TOP_WORDS = 200_000
#: Bits of the table in which a frequent context is looked up first.
SLOT_BITS = 18
#: The low bits of a key: 0, or in a cell the byte after the context. The next ones are the context's last byte.
LOW = np.uint64(0xFF)
#: By the byte before it, the code of a byte: white space and the start of a text share one.
CODE_OF = np.where(np.r_[True, _WHITE[1:]], 0, np.arange(256))
END = 0xFF  # never a byte of UTF-8; ends each text
#: Logits in tables are in steps of 1 / STEPS.
STEPS = 14
#: The first and last size of a block. Bytes of texts that are coded together, or of a part of a long text: all blocks of
#: growing size and then full ones. Bytes of texts whose contexts are looked up together.
FIRST_BLOCK, LAST_BLOCK = 64, 4096
GROWING = 2 * LAST_BLOCK - FIRST_BLOCK
LONG_BYTES, CODED_BYTES, PART_BYTES = 1 << 18, 1 << 17, 1 << 20
GATES, BINS = 4, 17
START_WEIGHTS = (0.15, 0.35, 0.55)
WEIGHT_RATE, BIN_RATE = 0.6, 0.5
#: Distinct cells of a kind that a counting task holds, and keys that an asking one does, before they are handed on.
HELD = 1 << 20
#: Bytes of training texts for each range of hashes, and of texts that are packed and scored together.
RANGE_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20


@dataclass
class Part:
    """Bytes of whole texts, each with its end, or of a part of one long text, after `lead` bytes that come before it."""

    raw: np.ndarray
    start: np.ndarray  # where texts begin
    lead: int
    docs: range
    size: np.ndarray  # bytes of each of docs, with its end


def parts(texts: Iterable[str | None]) -> Iterator[Part]:
    """All texts in their order; null: empty."""
    end = bytes([END])
    first, batch, size = 0, [], 0

    def joined() -> Part:
        sizes = np.array([len(t) + 1 for t in batch], np.int64)
        return Part(np.frombuffer(end.join([*batch, b""]), np.uint8), np.cumsum(sizes) - sizes, 0, range(first, first + len(batch)), sizes)

    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if batch and size + len(raw) > PART_BYTES or len(raw) > LONG_BYTES:
            if batch:
                yield joined()
            first, batch, size = i, [], 0
        if len(raw) <= LONG_BYTES:
            batch.append(raw)
            size += len(raw) + 1
            continue
        whole = np.frombuffer(raw + end, np.uint8)
        step = LONG_BYTES // LAST_BLOCK * LAST_BLOCK
        cuts = [0, *range(GROWING + step, len(whole), step), len(whole)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lead = min(a, WORD_BYTES + 4)
            yield Part(whole[a - lead : b], np.arange(a == 0), lead, range(i, i + 1), np.array([b - a]))
        first = i + 1
    if batch:
        yield joined()


def three_before(part: Part) -> np.ndarray:
    """The three bytes before each byte, the last one lowest, A-Z in lower case; 0 before the text."""
    raw, n = part.raw, len(part.raw)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    packed = np.zeros(n, np.uint32)
    for k in (1, 2, 3):
        packed[k:] |= low[: n - k].astype(np.uint32) << np.uint32(8 * k - 8)
    for k in (0, 1, 2):
        at = part.start + k
        packed[at[at < n]] &= np.uint32((1 << 8 * k) - 1)
    return packed[part.lead :]


def of_bytes(three: np.ndarray) -> np.ndarray:
    """The keys of contexts of two or three bytes, which can be read from them."""
    three = three.astype(np.uint64)
    return mixed(three) & np.uint64(0xFFFFFFFF << 32) | three << np.uint64(8)


@dataclass
class Words:
    """The different words of a part, each with the byte that ends it, one after the other.

    Of a part of a long text, or of one with a word that goes on in the next part, the bytes as they are."""

    raw: np.ndarray
    keys: np.ndarray  # of each byte's context: the word so far, or its last bytes
    times: np.ndarray  # how often each byte stands in the part
    hashes: np.ndarray  # of the words that aren't empty
    word_times: np.ndarray
    place: np.ndarray  # of each byte of the part in raw
    gate: np.ndarray  # of each byte of the part: how far its word has come
    starts: np.ndarray  # where the part's words begin, empty ones too
    which: np.ndarray  # the place of each in hashes, -1 if it is empty


def words_of(part: Part, *, placed: bool = True) -> Words:
    """placed: with place, gate and which, that only scoring looks at."""
    raw, low = part.raw, np.where((part.raw >= 65) & (part.raw <= 90), part.raw + 32, part.raw)
    up, down = powers(max(len(raw) + 1, PART_BYTES))

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(_BYTE[values] * up[: len(values)], out=out[1:])
        return out

    def contexts(low: np.ndarray, total: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The keys of what stands from `first` up to each byte."""
        last = np.where(first == np.arange(len(low)), 0, np.r_[np.uint8(0), low[:-1]]).astype(np.uint64)
        return mixed((total[:-1] - total[first]) * down[first]) & ~np.uint64(0xFFFF) | last << np.uint64(8)

    none = np.zeros(0, np.int64)
    if part.lead or len(part.docs) == 1 and part.raw[-1] != END:
        at = np.arange(len(raw))
        start = np.maximum(np.maximum.accumulate(np.where(np.r_[True, _WHITE[raw[:-1]]], at, 0)), at - WORD_BYTES)
        own, n = slice(part.lead, None), len(raw) - part.lead
        return Words(raw[own], contexts(low, sums(low), start)[own], np.ones(n, np.int64), none.astype(np.uint64), none, np.arange(n), np.minimum(at - start, GATES - 1)[own], none, none)
    end = np.flatnonzero(_WHITE[raw] | (raw == END))
    start = np.r_[0, end[:-1] + 1]
    total = sums(raw)
    one, back, times = _alike((total[end + 1] - total[start]) * down[start])
    size = end[one] + 1 - start[one]
    begin = np.cumsum(size) - size
    far = np.arange(size.sum()) - np.repeat(begin, size)
    at = far + np.repeat(start[one], size)
    low = low[at]
    total = sums(low)
    keys = contexts(low, total, np.arange(len(low)) - np.minimum(far, WORD_BYTES))
    some = size > 1
    length = (size - 1)[some].astype(np.uint64)
    hashes = mixed((total[(begin + size - 1)[some]] - total[begin[some]]) * down[begin[some]] + length) & ~LOW
    if not placed:
        return Words(raw[at], keys, np.repeat(times, size), hashes, times[some], none, none, start, none)
    every = end + 1 - start
    inside = np.arange(len(raw)) - np.repeat(start, every)
    which = np.where(some, np.cumsum(some) - 1, -1)[back]
    return Words(raw[at], keys, np.repeat(times, size), hashes, times[some], np.repeat(begin[back], every) + inside, np.minimum(inside, GATES - 1), start, which)


def _alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each different key, in their order, which of them each key is, and how often each stands: like np.unique,
    which takes twice as long because it looks for the first places."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.r_[True, own[1:] != own[:-1]][: len(own)]
    at = np.flatnonzero(new)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[at], back, np.diff(np.r_[at, len(keys)])


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray, *, mixed_up: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums; quick if the keys are a few sorted runs, or if it is told that they aren't."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind=None if mixed_up else "stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(n, at)


class Runs:
    """Sorted runs of keys and counts; beyond HELD distinct ones they are handed on."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.held = self.merged = 0

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> bool:
        """Whether they should be handed on."""
        keys, n = np.unique(keys, return_counts=True) if n is None else _summed(keys, n, mixed_up=True)
        self.keys.append(keys)
        self.n.append(n)
        self.held += len(keys)
        if self.held > max(HELD, 2 * self.merged):
            keys, n = self.all()
            self.keys, self.n, self.held, self.merged = [keys], [n], len(keys), len(keys)
        return self.merged > HELD

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate(self.keys), np.concatenate(self.n)) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _planes(values: np.ndarray) -> list[bytes]:
    """The differences of 64-bit values, their first bytes first: of values in order, most of those are zero."""
    return [np.diff(values.astype(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()]


def _sums_of(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64)[:, 0], dtype=np.uint64)


def pack(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Cells in order and their counts, in a fraction of their bytes: contexts, how many cells each has, and these."""
    context = cells >> np.uint64(8)
    at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(cells)])
    small = n.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if n.max(initial=0) <= np.iinfo(k).max))
    head = np.array([len(at), len(cells), small.itemsize], np.int64)
    own = np.diff(np.r_[at, len(cells)]).astype(np.uint16)
    return zstandard.ZstdCompressor(1).compress(b"".join([head.tobytes(), *_planes(context[at]), own.tobytes(), (cells & LOW).astype(np.uint8).tobytes(), small.tobytes()]))


def unpacked(rows: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all of `rows`, one after the other, and their counts."""
    cells, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in rows:
        raw = zstandard.ZstdDecompressor().decompress(row)
        k, m, size = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24 + 8 * k
        own = np.frombuffer(raw, np.uint16, k, at)
        cells.append(np.repeat(_sums_of(raw, 24, k) << np.uint64(8), own) | np.frombuffer(raw, np.uint8, m, at + 2 * k))
        counts.append(np.frombuffer(raw, f"u{size}", m, at + 2 * k + m).astype(np.int64))
    return np.concatenate(cells), np.concatenate(counts)


def pack_pairs(keys: np.ndarray, blocks: np.ndarray) -> bytes:
    """Keys in order within each of their blocks."""
    return zstandard.ZstdCompressor(1).compress(b"".join([np.array([len(keys)], np.int64).tobytes(), *_planes(keys), *_planes(blocks)]))


def unpacked_pairs(rows: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, blocks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in rows:
        raw = zstandard.ZstdDecompressor().decompress(row)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        keys.append(_sums_of(raw, 8, n))
        blocks.append(_sums_of(raw, 8 + 8 * n, n).astype(np.int64))
    return np.concatenate(keys), np.concatenate(blocks)


def _cut(sorted_values: np.ndarray) -> np.ndarray:
    """Where equal values begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]][: len(sorted_values)]), len(sorted_values)]


def _range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int32)


#: Counts: cells are keys | byte, packed with their numbers.
PACKED = "range int, kind int, cells binary"
_PACKED = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("cells", pa.binary())])


def _rows(schema: pa.Schema, first: np.ndarray, kind: int, packed: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(first, schema.types[0]), pa.array(np.full(len(first), kind, np.int32)), pa.array(packed, pa.binary())], schema=schema)


def _by_range(kind: int, cells: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row of PACKED for each range of the cells, which are in order."""
    place = _range_of(cells, bits)
    at = _cut(place)
    return _rows(_PACKED, place[at[:-1]], kind, [pack(cells[i:j], n[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])


def _long(text: str | None) -> bool:
    """Whether `parts` cuts the text, so that its words are hashed apart."""
    return text is not None and len(text) > LONG_BYTES // 4 and len(text.encode("utf-8", "surrogatepass")) > LONG_BYTES


def counted(docs: DataFrame, bits: int = 0) -> DataFrame:
    """The counts over all texts of `docs` in 2 ** bits ranges, a row (PACKED) for each range and kind at most.

    Kind 0: words by hash. Kind k: the bytes after each context of kind k that occurs LEAST_SEEN[k] times or more.
    """

    def given(runs: dict[int, Runs], kind: int) -> Iterator[pa.RecordBatch]:
        codes, n = runs.pop(kind, Runs()).all()
        if kind == 2 and len(codes):  # three bytes and the one after them; what is after two follows
            three, byte = codes >> np.uint64(8), codes & LOW
            for of, own in ((1, three & np.uint64(0xFFFF)), (2, three)):
                yield _by_range(of, *_summed(of_bytes(own) | byte, n), bits)
        elif len(codes):
            yield _by_range(kind, codes, n, bits)

    def count(batches):
        runs: dict[int, Runs] = {}

        def add(kind: int, *what) -> Iterator[pa.RecordBatch]:
            if runs.setdefault(kind, Runs()).add(*what):
                yield from given(runs, kind)

        for b in sliced(batches, 0):
            texts = b.column(0).to_pylist()
            for part in parts(texts):
                codes, n = np.unique(three_before(part) << np.uint32(8) | part.raw[part.lead :], return_counts=True)
                yield from add(2, codes.astype(np.uint64), n)
                words = words_of(part, placed=False)
                yield from add(3, words.keys | words.raw, words.times)
                yield from add(0, words.hashes, words.word_times)
            for w in word_hashes(t for t in texts if _long(t)):
                yield from add(0, w & ~LOW)
        for kind in list(runs):
            yield from given(runs, kind)

    def merge(rows: pa.Table) -> pa.Table:
        kinds, out = np.asarray(rows["kind"]), []
        for kind in np.unique(kinds):
            cells, n = _summed(*unpacked(rows["cells"].filter(pa.array(kinds == kind)).to_pylist()))
            if kind in LEAST_SEEN:
                at, total = _contexts(cells, n)
                keep = np.repeat(total >= LEAST_SEEN[kind], np.diff(np.r_[at, len(cells)]))
                cells, n = cells[keep], n[keep]
            if len(cells):
                out.append(_by_range(int(kind), cells, n, bits))
        return pa.Table.from_batches(out, _PACKED)

    return docs.select("text").mapInArrow(count, PACKED).groupBy("range").applyInArrow(merge, PACKED)


def _contexts(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells of each context begin, and its occurrences."""
    if not len(cells):
        return np.zeros(0, np.int64), n
    at = np.flatnonzero(np.r_[True, cells[1:] >> np.uint64(8) != cells[:-1] >> np.uint64(8)])
    return at, np.add.reduceat(n, at)


def _step(n: np.ndarray) -> np.ndarray:
    """Counts in steps of a sixteenth of a doubling, of which there are about a thousand."""
    return np.floor(16 * np.log2(n)).astype(np.int32)


def _code_of(keys: np.ndarray) -> np.ndarray:
    return CODE_OF[(keys >> np.uint64(8) & LOW).astype(np.int64)]


def _facts(counts: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(kind, step): distinct words or contexts of as many occurrences, and those; (-1, code << 8 | byte): 0 and the byte's
    occurrences in that code."""

    def facts(batches):
        for b in batches:
            for kind, row in zip(b["kind"].to_pylist(), b["cells"].to_pylist(), strict=True):
                cells, n = unpacked([row])
                total = _contexts(cells, n)[1]
                step = _step(total)
                groups = [(kind, step, 1, total)] + ([(-1, _code_of(cells) << 8 | (cells & LOW).astype(np.int64), 0, n)] if kind == 1 else [])
                for of, place, one, times in groups:
                    sums, places = np.bincount(place, times), np.bincount(place)
                    some = np.flatnonzero(places)
                    yield pa.record_batch([pa.array(np.full(len(some), of, np.int32)), pa.array(some.astype(np.int32)), pa.array(one * places[some]), pa.array(sums[some].astype(np.int64))], names=["kind", "step", "n", "times"])

    rows = counts.mapInArrow(facts, "kind int, step int, n long, times long").groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    return {(r["kind"], r["step"]): (r["n"], r["times"]) for r in rows.collect()}  # some thousand rows


def _most_frequent(counts: DataFrame, facts: dict, most: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind, the cells of the most frequent words or contexts, and their counts: as many steps from the top as hold
    `most` of the kind or fewer."""
    least = {}
    for kind, limit in most.items():
        held, least[kind] = 0, 1 << 30
        for step in sorted((s for k, s in facts if k == kind), reverse=True):
            held += facts[kind, step][0]
            if held > limit:
                break
            least[kind] = step

    def frequent(batches):
        for b in batches:
            for kind, row in zip(b["kind"].to_pylist(), b["cells"].to_pylist(), strict=True):
                cells, n = unpacked([row])
                at, total = _contexts(cells, n)
                keep = np.repeat(_step(total) >= least[kind], np.diff(np.r_[at, len(cells)]))
                if keep.any():
                    yield _by_range(kind, cells[keep], n[keep], 0)

    found, out = counts.mapInArrow(frequent, PACKED).toArrow(), {}
    kinds = np.asarray(found["kind"])
    for kind in most:
        out[kind] = _summed(*unpacked(found["cells"].filter(pa.array(kinds == kind)).to_pylist()))
    return out


@dataclass
class Code:
    """Huffman codes: the nodes and bits of byte b in code c stand at start[i] : start[i] + length[i], i = c << 8 | b."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """counts: a row of 256 for each code; what hasn't been counted shares the code of all bytes."""
    every = _lengths(counts.sum(0))
    start, length, node, bit, at = [], [], [], [], 0
    shared = None
    for row in counts:
        if row.any() or shared is None:
            own = _lengths(row) if row.any() else every
            size = np.array([len(path) for path in own])
            begin = at + np.cumsum(size) - size
            node += [x for path in own for x, _ in path]
            bit += [y for path in own for _, y in path]
            at += int(size.sum())
            if not row.any():
                shared = begin, size
        else:
            begin, size = shared
        start.append(begin)
        length.append(size)
    return Code(np.concatenate(start), np.concatenate(length), np.array(node, np.int64), np.array(bit, np.int8))


def _lengths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each byte, the nodes (0 to 254) and bits from the root of the code."""
    heap = [(int(n) + 1, b, b) for b, n in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    made = 256
    while len(heap) > 1:
        (n, _, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        above[x], above[y] = (made, 0), (made, 1)
        heapq.heappush(heap, (n + m, made, made))
        made += 1
    out = []
    for x in range(256):
        path = []
        while x in above:
            x, y = above[x]
            path.append((x - 256, y))
        out.append(path[::-1])
    return out


def _logits(code: Code, row: np.ndarray, byte: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """The logits of contexts at their codes' 255 nodes, flat, from the counts n of bytes (code << 8 | byte) after them,
    which are by row."""
    out = np.zeros(rows * 255, np.int8)
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row >> 12)) + 1):  # the rows of 4,096 contexts at once
        if len(part):
            length = code.length[byte[part]]
            at = np.arange(length.sum()) + np.repeat(code.start[byte[part]] - (np.cumsum(length) - length), length)
            place, bit, times = np.repeat(row[part] * 255, length) + code.node[at], code.bit[at], np.repeat(n[part], length)
            order = np.argsort(place, kind="stable")
            place, bit, times = place[order], bit[order], times[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            every, one = np.add.reduceat(times, first), np.add.reduceat(times * bit, first)
            out[place[first]] = np.clip(np.rint(np.log((one + 0.4) / (every - one + 0.4)) * STEPS), -127, 127)
    return out


def _table(cells: np.ndarray, n: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of cells, which are in order, and their logits."""
    first = np.r_[True, cells[1:] >> np.uint64(8) != cells[:-1] >> np.uint64(8)][: len(cells)]
    keys = cells[first] & ~LOW
    return keys, _logits(code, np.cumsum(first) - 1, _code_of(cells) << 8 | (cells & LOW).astype(np.int64), n, len(keys))


def _found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places of keys among others, which are in order; -1 where there is none."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


class Table:
    """Known contexts. One is looked up in its slot, and if another one holds that, by bisection."""

    def __init__(self, keys: np.ndarray) -> None:
        slot, order = _slots(keys), np.arange(len(keys))[::-1]
        self.tag, self.row = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
        self.tag[slot[order]], self.row[slot[order]] = keys[order], order
        rest = np.flatnonzero(self.tag[slot] != keys)
        self.other, self.other_row = keys[rest], np.r_[rest, -1].astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of contexts, -1 where they aren't known."""
        slot = _slots(keys)
        out = self.row[slot]
        miss = np.flatnonzero(self.tag[slot] != keys)
        out[miss] = self.other_row[_found(keys[miss], self.other)]
        return out


class Mixer:
    def __init__(self, code: Code, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """tables: one of each kind of context, its keys in order and their logits."""
        self.code = code
        #: Undecided logits, then those of all tables; a part's own ones come after them.
        self.logits = np.concatenate([np.zeros(255, np.int8), *(x for _, x in tables)])
        self.first = np.cumsum([1, *(len(keys) for keys, _ in tables)])
        two, three = (keys >> np.uint64(8) & np.uint64(0xFFFFFF) for keys, _ in tables[:2])
        # rows of two bytes, and of three by the row of two and the third; 0 for none
        self.of_two = np.zeros(1 << 16, np.int32)
        self.of_two[two.astype(np.int64)] = np.arange(len(two)) + 1
        self.of_three = np.zeros((len(two) + 1) << 8, np.int32)
        self.of_three[self.of_two[(three & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64) << 8 | (three >> np.uint64(16)).astype(np.int64)] = np.arange(len(three)) + self.first[1]
        self.of_three[:256] = 0  # three bytes whose two aren't in the table are looked up like others that it lacks
        self.words = Table(tables[2][0])

    def rows(self, three: np.ndarray, words: Words) -> list[np.ndarray]:
        """Of each byte, the rows of its contexts; that of the word for each of the words' bytes. 0 for none."""
        three = three.astype(np.int64)
        two = self.of_two[three & 0xFFFF]
        word = self.words.find(words.keys)
        return [two, self.of_three[two.astype(np.int64) << 8 | three >> 16], np.where(word < 0, 0, word + np.int32(self.first[2]))]

    def asked(self, part: Part, words: Words) -> Iterator[tuple[int, np.ndarray]]:
        """By kind, the contexts that no table here holds; they may be repeated."""
        three = three_before(part)
        rows = self.rows(three, words)
        for kind, row, bits in ((1, rows[0], 0xFFFF), (2, rows[1], 0xFFFFFF)):
            yield kind, of_bytes(np.unique(three[row == 0] & np.uint32(bits)))
        yield 3, words.keys[rows[2] == 0]

    def bits(self, texts: list[str | None], cells: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, seen=lambda part, words: None) -> np.ndarray:
        """The code length of each text in bits; cells: by kind, what was counted of contexts that the tables don't hold.
        seen: gets each part and its words."""
        out = np.zeros(len(texts))
        for part in parts(texts):
            if not part.lead:
                state = [np.full(len(part.docs) * GATES, w / STEPS, np.float32) for w in START_WEIGHTS], np.zeros(len(part.docs) * BINS, np.float32)
            words, three = words_of(part), three_before(part)
            seen(part, words)
            rows = self._predicted(three, words, cells or {})
            symbol = CODE_OF[(three & np.uint32(0xFF)).astype(np.int64)] << 8 | part.raw[part.lead :]
            ends = np.cumsum(part.size)
            one = 0
            while one < len(ends):  # texts that are coded together
                begin = ends[one] - part.size[one]
                two = max(one + 1, int(np.searchsorted(ends, begin + CODED_BYTES, "right")))
                s, weights = slice(begin, ends[two - 1]), [w[one * GATES : two * GATES] for w in state[0]]
                out[part.docs.start + one : part.docs.start + two] += self._coded(symbol[s], part.size[one:two], words.gate[s], [r[s] for r in rows], bool(part.lead), weights, state[1][one * BINS : two * BINS])
                one = two
        return out

    def _predicted(self, three: np.ndarray, words: Words, cells: dict) -> list[np.ndarray]:
        """For each kind of context, each byte's row in the logits: that of the next shorter context where a context isn't
        known, of undecided logits where none is. The logits of what the part needs of `cells` come after the tables'."""
        found, added, held = self.rows(three, words), [], int(self.first[-1])
        for kind, row in zip(KINDS, found, strict=True):
            if kind in cells and len(miss := np.flatnonzero(row == 0)):
                own, n = cells[kind]
                k = words.keys[miss] if kind == 3 else three[miss] & np.uint32(0xFFFF if kind == 1 else 0xFFFFFF)
                one, back, _ = _alike(k)
                some = k[one]
                need = some if kind == 3 else np.sort(of_bytes(some))
                low, high = np.searchsorted(own, need), np.searchsorted(own, need | LOW, "right")
                at = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
                others, more = _table(own[at], n[at], self.code)
                place = _found(some if kind == 3 else of_bytes(some), others)[back]
                row[miss] = np.where(place < 0, 0, place + held)
                added.append(more)
                held += len(others)
        if len(self.logits) < held * 255:
            self.logits = np.concatenate([self.logits[: self.first[-1] * 255], np.zeros((held - self.first[-1]) * 300, np.int8)])
        at = self.first[-1] * 255
        for x in added:
            self.logits[at : at + len(x)] = x
            at += len(x)
        two, more, word = found[0], found[1], found[2][words.place]
        more = np.where(more == 0, two, more)
        return [two, more, np.where(word == 0, more, word)]

    def _coded(self, symbol: np.ndarray, size: np.ndarray, gate: np.ndarray, rows: list[np.ndarray], later: bool, weights: list[np.ndarray], shift: np.ndarray) -> np.ndarray:
        """The code lengths of texts of so many bytes (code << 8 | byte); later: all blocks are full ones. weights and shift are refined."""
        # bytes in the order of blocks, then of texts, then of gates: each set of weights has one run in each block
        edges = [0, LAST_BLOCK if later else FIRST_BLOCK]
        while edges[-1] < size.max():
            edges.append(edges[-1] + min(2 * (edges[-1] - edges[-2]), LAST_BLOCK))
        doc = np.repeat(np.arange(len(size)), size)
        block_at = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        block = block_at[np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size)]
        place = (block * len(size) + doc) * GATES + gate
        order = np.argsort(place.astype(np.uint16) if place.max() < 1 << 16 else place, kind="stable")  # 16 bits are sorted in a pass
        symbol, block, own = symbol[order], block[order], (doc * GATES + gate)[order]
        # numpy looks 64-bit places up far faster than others
        bases = [row[order].astype(np.int64) * 255 for row in rows]
        nodes, signs = self.code.node, (2 * self.code.bit - 1).astype(np.float32)
        lengths, starts = self.code.length[symbol], self.code.start[symbol]
        run = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])])
        run_end, runs = np.r_[run[1:], len(symbol)], own[run]
        out = np.zeros(len(size))
        cuts = np.searchsorted(block[run], np.arange(len(edges)))
        for one, two in zip(cuts[:-1], cuts[1:], strict=True):
            if one == two:
                continue
            s, mine = slice(run[one], run_end[two - 1]), runs[one:two]
            length = lengths[s]
            ends = np.cumsum(length)
            byte = np.repeat(np.arange(len(length)), length)  # looking up by it takes half as long as repeating again
            at = (starts[s] - (ends - length)).take(byte, mode="wrap")
            at += np.arange(ends[-1])
            node, sign = nodes.take(at, mode="wrap"), signs.take(at, mode="wrap")
            first = np.r_[0, ends][run[one:two] - run[one]]
            n = np.diff(np.r_[first, ends[-1]])
            x = []
            for base in bases:
                base[s].take(byte, out=at, mode="wrap")
                at += node
                x.append(self.logits.take(at, mode="wrap").astype(np.float32))
            mix = np.repeat(weights[0][mine], n) * x[0]
            for w, v in zip(weights[1:], x[1:], strict=True):
                mix += np.repeat(w[mine], n) * v
            place = mix * np.float32(2)
            place += np.float32(BINS / 2)
            np.minimum(np.maximum(place, 0, out=place), np.float32(BINS - 0.5), out=place)
            bin_ = place.astype(np.int64)
            bin_ += np.repeat(mine // GATES * BINS, n)
            mix += shift.take(bin_, mode="wrap")
            mix *= -sign
            e = np.exp(np.minimum(mix, np.float32(30), out=mix), out=mix)
            np.add.at(out, mine // GATES, np.add.reduceat(np.log(1 + e), first) / np.log(2))
            wrong = e / (1 + e)
            wrong *= sign
            for w, v in zip(weights, x, strict=True):
                v *= wrong
                w[mine] += np.float32(WEIGHT_RATE / STEPS**2) * np.add.reduceat(v, first) / (n + 8).astype(np.float32)
            shift += (4 * BIN_RATE * np.bincount(bin_, wrong.astype(float), len(shift)) / (np.bincount(bin_, minlength=len(shift)) + 16)).astype(np.float32)
        return out


#: Texts: the rows of a block of them, as an Arrow stream.
BLOCKS = "block long, rows binary"
ASKED = "range int, kind int, keys binary"
_ASKED = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary())])
TOLD = "block long, kind int, cells binary"
_TOLD = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("cells", pa.binary())])


def _packed(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, text last, in blocks (BLOCKS) of about BLOCK_BYTES, which stay together from here on."""

    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        for i, b in enumerate(sliced(batches, text_at, BLOCK_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.record_batch([pa.array([first + i]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    text_at = len(docs.columns) - 1
    return docs.mapInArrow(pack, BLOCKS)


def _asks(blocks: DataFrame, model, bits: int) -> DataFrame:
    """What the tables of `model` don't hold of blocks of texts, each once a block, by ranges of hashes (ASKED)."""

    def ask(batches):
        mixer, known, _ = model.value
        waiting: dict[int, list] = {kind: [] for kind in (0, *KINDS)}
        held = 0

        def given():
            for kind, pairs in waiting.items():
                if pairs:
                    keys = np.concatenate([k for _, k in pairs])
                    block = np.repeat([b for b, _ in pairs], [len(k) for _, k in pairs])
                    order = np.argsort(_range_of(keys, bits), kind="stable")
                    keys, block = keys[order], block[order]
                    place = _range_of(keys, bits)
                    at = _cut(place)
                    yield _rows(_ASKED, place[at[:-1]], kind, [pack_pairs(keys[i:j], block[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
                    pairs.clear()

        for b in batches:
            for block, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                texts = pa.ipc.open_stream(rows.as_buffer()).read_all().columns[-1].to_pylist()
                asked: dict[int, list] = {kind: [] for kind in waiting}
                for part in parts(texts):
                    words = words_of(part, placed=False)
                    for kind, keys in mixer.asked(part, words):
                        asked[kind].append(keys)
                    asked[0].append(words.hashes)
                asked[0] += [w & ~LOW for w in word_hashes(t for t in texts if _long(t))]
                for kind, keys in asked.items():
                    own = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]))
                    own = own if kind else own[_found(own, known) < 0]
                    if len(own):
                        waiting[kind].append((block, own))
                        held += len(own)
                if held > HELD:
                    yield from given()
                    held = 0
        yield from given()

    return blocks.mapInArrow(ask, ASKED)


def _answers(counts: DataFrame, asks: DataFrame) -> DataFrame:
    """What the counts hold of what is asked, by block (TOLD)."""

    def answer(counts: pa.Table, asks: pa.Table) -> pa.Table:
        asked, out = np.asarray(asks["kind"]), []
        for kind, row in zip(counts["kind"].to_pylist(), counts["cells"].to_pylist(), strict=True):
            cells, n = unpacked([row])
            keys, block = unpacked_pairs(asks["keys"].filter(pa.array(asked == kind)).to_pylist())
            low = np.searchsorted(cells, keys)
            many = np.searchsorted(cells, keys | LOW, "right") - low
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            block = np.repeat(block, many)
            order = block.argsort(kind="stable")
            at, block = at[order], block[order]
            cut = _cut(block)
            out.append(_rows(_TOLD, block[cut[:-1]], kind, [pack(cells[at[i:j]], n[at[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]))
        return pa.Table.from_batches(out, _TOLD)

    return counts.groupBy("range").cogroup(asks.groupBy("range")).applyInArrow(answer, TOLD)


def scored(docs: DataFrame, training: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and others) with what `training` (text) says about each whole text: n_tokens (words and one
    end), n_known, train_tokens, base_score (log10, unigrams with one added), bits (code length by the mixer) and
    bits_per_byte (of the text and its end).

    Null texts count as empty, in training too. Without training texts all predictors stay undecided. Rows stay as they
    are, repeated ones too; columns of those names are replaced, text is left out.
    """
    spark = docs.sparkSession
    ends, train_bytes = training.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = ceil(log2(max(1.0, train_bytes / RANGE_BYTES)))
    counts = written(counted(training, bits), "lm-counts")
    facts = _facts(counts)
    of_words = [v for (kind, _), v in facts.items() if kind == 0]
    n_train, n_words = ends + sum(times for _, times in of_words), int(ends > 0) + sum(n for n, _ in of_words)
    code = huffman(np.array([facts.get((-1, b), (0, 0))[1] for b in range(1 << 16)]).reshape(256, 256))
    top = _most_frequent(counts, facts, {0: TOP_WORDS} | dict.fromkeys(KINDS, TOP_CONTEXTS))
    mixer = Mixer(code, [_table(*top[kind], code) for kind in KINDS])
    model = spark.sparkContext.broadcast((mixer, top[0][0], np.log10(top[0][1] + 1.0)))
    below, end_log = float(np.log10(n_train + n_words + 1.0)), float(np.log10(ends + 1.0))

    names = ("n_tokens", "n_known", "train_tokens", "base_score", "bits", "bits_per_byte")
    kept = [c for c in docs.columns if c not in ("text", *names)]
    types = (T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, t) for c, t in zip(names, types, strict=True))])

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        mixer, known, logs = model.value
        kinds, cells = np.asarray(told["kind"]), {}
        for kind in np.unique(kinds):
            cells[int(kind)] = _summed(*unpacked(told["cells"].filter(pa.array(kinds == kind)).to_pylist()))
        others, times = cells.pop(0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        other_logs = np.log10(times + 1.0)
        out = []
        for rows in texts["rows"]:
            rows = pa.ipc.open_stream(rows.as_buffer()).read_all()
            column = rows.columns[-1].to_pylist()
            tokens, found, base = np.zeros(len(column), np.int64), np.full(len(column), int(ends > 0)), np.full(len(column), end_log)

            def add(docs, begins, value, own, hit) -> None:
                for to, x in ((tokens, own), (found, hit), (base, value)):
                    to[docs] += np.add.reduceat(x, begins) if len(x) else x.sum()

            def told_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at, more = _found(w, known), _found(w, others)
                return np.r_[logs, 0.0][at] + np.r_[other_logs, 0.0][more], (at >= 0) | (more >= 0)

            def seen(part: Part, words: Words) -> None:
                if len(words.starts):
                    value, hit = told_of(words.hashes)
                    empty = words.which < 0
                    add(slice(part.docs.start, part.docs.stop), np.searchsorted(words.starts, part.start), np.r_[value, 0.0][words.which], (~empty).astype(np.int64), np.r_[hit, False][words.which].astype(np.int64))

            coded = mixer.bits(column, cells, seen)
            for i, t in enumerate(column):
                if _long(t):
                    for w in word_hashes([t]):
                        value, hit = told_of(w & ~LOW)
                        add(i, [0], value, np.ones(len(w), np.int64), hit.astype(np.int64))
            base -= (tokens + 1) * below
            lengths = np.array([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in column], float)
            new = [pa.array(tokens + 1), pa.array(found), pa.array([n_train] * len(column), pa.int64()), pa.array(base), pa.array(coded), pa.array(coded / lengths)]
            out.append(pa.table([*rows.columns[:-1], *new], names=schema.names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], f.type) for f in to_arrow_schema(schema)], names=schema.names)

    blocks = written(_packed(docs.select(*kept, "text")), "lm-texts")
    told = _answers(counts, _asks(blocks, model, bits))
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32(doc_id) mod 7 is not 2: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10), bits_per_byte."""
    docs = documents(spark, sf_dir).select("doc_id", "text", (crc32_of(F.col("doc_id")) % 7 == 2).alias("held_out"))
    out = scored(docs, docs.where(~F.col("held_out")).select("text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("bits") * F.lit(-float(np.log10(2.0)))).alias("score"), "bits_per_byte")

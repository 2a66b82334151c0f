"""Packed postings: blocks of up to 128 documents of a term, their numbers in as few bits as the block needs.

A block is a row: its term, its first and last doc_id, and binary columns that a search reads or leaves: the differences of
doc_ids, the frequencies and lengths, and the offsets. `tops` are the (tf, length) pairs of the block that no other pair of it
beats in both: whatever the weights, the largest score in the block is that of one of them. They are kept of whole blocks; the
short one that ends a term has none, and is looked at itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Postings of a block.
BLOCK = 128
#: Postings that are packed or unpacked together.
TOGETHER = 1 << 16
#: Postings that a task puts in order and packs before they are shuffled, as many as its memory holds with ease.
GATHERED = 1 << 20

_TOPS = pa.list_(pa.struct([("tf", pa.int64()), ("token_count", pa.int64())]))
_NAMES = ["term", "block", "n", "first_doc", "last_doc", "tops", "cap", "bits", "docs", "counts", "offsets"]
SCHEMA = "term string, block long, n int, first_doc long, last_doc long, tops array<struct<tf:long,token_count:long>>, cap int, bits binary, docs binary, counts binary, offsets binary"
_ARROW = pa.schema(list(zip(_NAMES, [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), _TOPS, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()], strict=True)))


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of unsigned numbers, 0 for 0."""
    v, out = values.astype(np.uint64), np.zeros(len(values), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        large = v >= np.uint64(1) << np.uint64(step)
        out[large] += step
        v[large] >>= np.uint64(step)
    return out + (v > 0)


def _places(width: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number's bits begin, and where each block's bytes do (and the end): blocks start at whole bytes."""
    size = (width * count + 7) // 8
    start = np.r_[0, np.cumsum(size)]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start[:-1] * 8, count) + nth * np.repeat(width, count), start


def pack(values: np.ndarray, width: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of blocks, so many of each, in so many bits: bytes, and where each block's begin (and the end)."""
    bit, start = _places(width, count)
    out = np.zeros(start[-1] + 9)
    v, shift, byte = values.astype(np.uint64), (bit & 7).astype(np.uint64), bit >> 3
    low = v << shift
    high = np.where(shift > 0, v >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    for j in range(8):  # bits of different numbers never meet, so that sums are unions
        part = (low >> np.uint64(8 * j)) & np.uint64(255)
        if part.any():
            out += np.bincount(byte + j, part, len(out))
    out += np.bincount(byte + 8, high, len(out))
    return out[: start[-1]].astype(np.uint8), start


def unpack(data: np.ndarray, width: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers again, unsigned, block after block."""
    bit, _ = _places(width, count)
    raw = np.r_[data, np.zeros(9, np.uint8)].astype(np.uint64)
    shift, byte = (bit & 7).astype(np.uint64), bit >> 3
    word = np.zeros(len(bit), np.uint64)
    for j in range(8):
        word |= raw[byte + j] << np.uint64(8 * j)
    last = np.where(shift > 0, raw[byte + 8] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    each = np.repeat(width, count).astype(np.uint64)
    mask = np.where(each >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(each, np.uint64(63))) - np.uint64(1))
    return ((word >> shift) | last) & mask


def _binaries(data: np.ndarray, start: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary or string column, one after the other, and where each value's begin (and the end)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _most(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Bits of the largest number of each block; blocks may be empty."""
    if not len(values):
        return np.zeros(len(cut) - 1, np.int64)
    padded = np.concatenate([values, np.zeros(1, values.dtype)])
    most = np.maximum.reduceat(padded, np.minimum(cut[:-1], len(values)))
    return np.where(np.diff(cut) > 0, bit_lengths(most), 0)


def _tops(tf: np.ndarray, length: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Of each whole block the pairs that no other beats: by falling tf, those with a length below all before them."""
    block = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((length, -tf, block))
    b, n = block[order], length[order]
    # a running minimum in each block: lengths made to fall below those of earlier blocks
    room = int(n.max(initial=0)) + 1
    lowered = n - b * room
    before = np.r_[np.iinfo(np.int64).max, np.minimum.accumulate(lowered)[:-1]] if len(n) else lowered
    first = np.r_[True, b[1:] != b[:-1]][: len(b)]
    top = first | (lowered < before)
    whole = np.diff(cut) == BLOCK
    top &= whole[b]
    chosen = order[top]
    pairs = pa.StructArray.from_arrays([pa.array(tf[chosen]), pa.array(length[chosen])], ["tf", "token_count"])
    at = np.r_[0, np.cumsum(np.bincount(b[top], minlength=len(cut) - 1))]
    # a list without a beginning is null
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.r_[~whole, False]), pairs)


def _blocks(terms: pa.Array, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, offsets: np.ndarray, kept: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    """Blocks of postings in order; cut: where each begins (and the end). offsets: `kept` of each posting."""
    n = np.diff(cut)
    first = np.zeros(len(doc), bool)
    first[cut[:-1]] = True
    gap = np.concatenate([np.zeros(1, np.uint64), np.diff(doc.view(np.uint64))])[~first]
    gap_cut = np.r_[0, np.cumsum(n - 1)]
    docs_bits = _most(gap, gap_cut)
    docs = _binaries(*pack(gap, docs_bits, n - 1))
    tf_bits, len_bits = _most(tf - 1, cut), _most(length, cut)
    tf_raw, tf_at = pack(tf - 1, tf_bits, n)
    len_raw, len_at = pack(length, len_bits, n)
    # of each posting the first offset, then the gaps of all
    at = np.r_[0, np.cumsum(kept)]
    start = np.zeros(len(offsets) + 1, bool)
    start[at[:-1][kept > 0]] = True
    start = start[:-1]
    off_gap = np.r_[0, np.diff(offsets)][~start] if len(offsets) else offsets
    heads = np.add.reduceat(np.r_[(kept > 0).astype(np.int64), 0], cut[:-1]) if len(n) else n
    tails = np.add.reduceat(np.r_[np.maximum(kept - 1, 0), 0], cut[:-1]) if len(n) else n
    head_bits, tail_bits = _most(offsets[start], np.r_[0, np.cumsum(heads)]), _most(off_gap, np.r_[0, np.cumsum(tails)])
    head_raw, head_at = pack(offsets[start], head_bits, heads)
    tail_raw, tail_at = pack(off_gap, tail_bits, tails)
    cap = int(kept.max(initial=0))
    if (kept != np.minimum(tf, cap)).any():
        raise ValueError("postings must keep their first offsets, up to the same number")
    bits = np.stack([docs_bits, tf_bits, len_bits, head_bits, tail_bits], axis=1).astype(np.uint8).ravel()
    columns = [
        terms.take(pa.array(cut[:-1])),
        pa.array(np.zeros(len(n), np.int64)),
        pa.array(n.astype(np.int32)),
        pa.array(doc[cut[:-1]]),
        pa.array(doc[cut[1:] - 1]),
        _tops(tf, length, cut),
        pa.array(np.full(len(n), cap, np.int32)),
        _binaries(bits, np.arange(len(n) + 1) * 5),
        docs,
        _joined([(tf_raw, tf_at), (len_raw, len_at)]),
        _joined([(head_raw, head_at), (tail_raw, tail_at)]),
    ]
    return pa.record_batch([c.cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _joined(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Of several packed columns one: each block's bytes one after the other."""
    sizes = np.stack([np.diff(at) for _, at in parts], axis=1)
    start = np.r_[0, np.cumsum(sizes.sum(axis=1))]
    out = np.zeros(start[-1], np.uint8)
    here = start[:-1].copy()
    for (raw, at), size in zip(parts, sizes.T, strict=True):
        out[np.repeat(here - at[:-1], size) + np.arange(len(raw))] = raw
        here += size
    return _binaries(out, start)


def _taken(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """So many bytes from there on of each block."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def blocks(postings: DataFrame) -> DataFrame:
    """Packed blocks of postings (term, doc_id, tf, token_count, offsets) that stand in the order of term and doc_id within
    partitions. A term that two partitions share has a short block more. Terms and numbers (block) together name a block."""

    def run(batches):
        yield from _streamed(pa.Table.from_batches([b.slice(i, TOGETHER)]) for b in batches for i in range(0, b.num_rows, TOGETHER))

    return postings.select("term", "doc_id", "tf", "token_count", "offsets").mapInArrow(run, SCHEMA)


def _streamed(parts: Iterator[pa.Table], *, ordered: bool = True) -> Iterator[pa.RecordBatch]:
    """Blocks of postings, some at a time, in the order of terms. ordered: and of doc_id, else they are put in order, as far as
    they are at hand together."""
    number = TaskContext.get().partitionId() << 32
    rest: pa.Table | None = None
    last, done = None, 0  # the last term, and its blocks so far
    for some in parts:
        rest = some if rest is None else pa.concat_tables([rest, some])
        made, rest = _cut_blocks(rest if ordered else _in_order(rest), False)
        if made is not None:
            made, last, done = _numbered(made, number, last, done)
            yield made
    if rest is not None and rest.num_rows:
        yield _numbered(_cut_blocks(rest, True)[0], number, last, done)[0]


def _in_order(rows: pa.Table) -> pa.Table:
    """Postings by term and doc_id."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return rows
    coded = rows["term"].chunk(0).dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int64)
    place[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(place))
    code, doc = place[np.asarray(coded.indices)], np.asarray(rows["doc_id"].chunk(0)).astype(np.int64)
    if ((code[1:] > code[:-1]) | ((code[1:] == code[:-1]) & (doc[1:] >= doc[:-1]))).all():
        return rows
    return rows.take(pa.array(np.lexsort((doc, code))))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings in any order, GATHERED at a time: most are short, and those of a term overlap. `merged` makes whole ones
    of them."""
    waiting: list[pa.Table] = []
    n = 0

    def made() -> pa.RecordBatch:
        return _cut_blocks(_in_order(pa.concat_tables(waiting)), True)[0]

    for b in batches:
        for i in range(0, b.num_rows, GATHERED):
            some = b.slice(i, GATHERED)
            waiting.append(pa.Table.from_batches([some]))
            n += some.num_rows
            if n >= GATHERED:
                yield made()
                waiting.clear()
                n = 0
    if n:
        yield made()


def partly(postings: DataFrame) -> DataFrame:
    """`gathered` blocks of postings (term, doc_id, tf, token_count, offsets) as they stand."""
    return postings.select("term", "doc_id", "tf", "token_count", "offsets").mapInArrow(gathered, SCHEMA)


def merged(rows: DataFrame) -> DataFrame:
    """Whole blocks of `gathered` ones that stand in the order of term and first_doc within partitions. A term that two partitions
    share has a short block more. Documents that are at hand together are put in order, so that blocks hardly overlap."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for b in batches:
            part = np.cumsum(np.asarray(b.column("n")).astype(np.int64)) // TOGETHER
            cuts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]).tolist(), len(part)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                some = b.slice(i, j - i)
                for row, doc, tf, length, offsets in _unpacked(some, True):
                    yield pa.table([some.column("term").take(pa.array(row)), pa.array(doc), pa.array(tf), pa.array(length), offsets], names=["term", "doc_id", "tf", "token_count", "offsets"])

    return rows.select(_NAMES).mapInArrow(lambda batches: _streamed(parts(batches), ordered=False), SCHEMA)


def _numbered(made: pa.RecordBatch, number: int, last: str | None, done: int) -> tuple[pa.RecordBatch, str, int]:
    """With the blocks' numbers within their terms, from `number` on; the last term, and its blocks so far."""
    code = np.asarray(made.column("term").dictionary_encode().indices).astype(np.int64)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    nth = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    if made.column("term")[0].as_py() == last:
        nth[code == code[0]] += done
    return made.set_column(1, "block", pa.array(nth + number)), made.column("term")[-1].as_py(), int(nth[-1]) + 1


def _cut_blocks(rows: pa.Table, all_of_them: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return None, rows
    term = rows["term"].chunk(0)
    coded = term.dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    nth = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    cut = np.flatnonzero(nth % BLOCK == 0)
    end = len(code)
    if not all_of_them:  # the last one may go on
        end, cut = cut[-1], cut[:-1]
    if not len(cut):
        return None, rows
    some = rows.slice(0, end)
    doc, tf, length = (np.asarray(some[c].combine_chunks()).astype(np.int64) for c in ("doc_id", "tf", "token_count"))
    lists = some["offsets"].chunk(0)
    kept = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    offsets = np.asarray(pc.list_flatten(lists)).astype(np.int64)
    return _blocks(some["term"].chunk(0), doc, tf, length, offsets, kept, np.r_[cut, end]), rows.slice(end)


def _unpacked(b: pa.RecordBatch, with_offsets: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array | None]]:
    """Of some blocks: for each posting its block's row, doc_id, tf, token_count, and offsets if they are asked for."""
    n = np.asarray(b.column("n")).astype(np.int64)
    width = bytes_of(b.column("bits"))[0].reshape(-1, 5).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    gaps = unpack(bytes_of(b.column("docs"))[0], width[:, 0], n - 1)
    step = np.zeros(len(row), np.uint64)
    first = np.cumsum(n) - n
    inner = np.ones(len(row), bool)
    inner[first] = False
    step[inner] = gaps
    run = np.cumsum(step)
    doc = (run - np.repeat(run[first], n) + np.repeat(np.asarray(b.column("first_doc")).astype(np.int64).view(np.uint64), n)).view(np.int64)
    raw = bytes_of(b.column("counts"))[0]
    sizes = [(width[:, i] * n + 7) // 8 for i in (1, 2)]
    start = np.cumsum(sizes[0] + sizes[1]) - sizes[0] - sizes[1]
    tf = unpack(_taken(raw, start, sizes[0]), width[:, 1], n).astype(np.int64) + 1
    length = unpack(_taken(raw, start + sizes[0], sizes[1]), width[:, 2], n).astype(np.int64)
    if not with_offsets:
        yield row, doc, tf, length, None
        return
    raw, start = bytes_of(b.column("offsets"))
    start = start[:-1]
    kept = np.minimum(tf, np.repeat(np.asarray(b.column("cap")).astype(np.int64), n))
    heads, tails = (np.add.reduceat(np.r_[x, 0], first) for x in ((kept > 0).astype(np.int64), np.maximum(kept - 1, 0)))
    head_size, tail_size = (width[:, 3] * heads + 7) // 8, (width[:, 4] * tails + 7) // 8
    head = unpack(_taken(raw, start, head_size), width[:, 3], heads).astype(np.int64)
    tail = unpack(_taken(raw, start + head_size, tail_size), width[:, 4], tails).astype(np.int64)
    at = np.r_[0, np.cumsum(kept)]
    is_head = np.zeros(at[-1], bool)
    is_head[at[:-1][kept > 0]] = True
    steps = np.zeros(at[-1], np.int64)
    steps[~is_head] = tail
    total = np.cumsum(steps)
    own = kept[kept > 0]
    offsets = total - np.repeat(total[is_head], own) + np.repeat(head, own)
    yield row, doc, tf, length, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(offsets))


def unpacked(rows: DataFrame, *, with_offsets: bool = True) -> DataFrame:
    """The postings of blocks: term, block, doc_id, tf, token_count, and offsets if they are asked for (else the column isn't
    read). Other columns of the blocks are left out."""
    columns = ["term", "block", "n", "first_doc", "bits", "docs", "counts", *(["cap", "offsets"] if with_offsets else [])]
    schema = "term string, block long, doc_id long, tf long, token_count long" + (", offsets array<long>" if with_offsets else "")
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER // BLOCK):
                some = b.slice(i, TOGETHER // BLOCK)
                for row, doc, tf, length, offsets in _unpacked(some, with_offsets):
                    at = pa.array(row)
                    lists = [] if offsets is None else [offsets]
                    yield pa.record_batch([some.column("term").take(at), some.column("block").take(at), pa.array(doc), pa.array(tf), pa.array(length), *lists], names=names)

    return rows.select(columns).mapInArrow(run, schema)


def packable(postings: DataFrame) -> bool:
    """Whether doc_ids are whole numbers."""
    return isinstance(postings.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

"""Baseline JPEG in a binary column: bytes stored as flat blocks, and DC-only luminance thumbnails of any baseline file.

Storing: a payload byte v is the level of one flat 8x8 block (DC quantiser 8, so that level and DC agree), 64 blocks a
row and a restart marker after each row; what a DC-only thumbnail of the file shows is the payload. A payload of more
rows than a JPEG may have becomes several JPEGs one after the other.

Reading: the intervals between restart markers don't depend on each other, so all those of a batch of files with the
same tables are decoded at once, one block of each per numpy step.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, sliced

ROW = 64
MAX_ROWS = 8191
#: Payload bytes that are encoded or decoded together.
BATCH_BYTES = 1 << 20
# Code lengths and symbols of the DC luminance table in Annex K of ITU-T T.81.
DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
#: Flat blocks have no AC coefficients: the end of a block is the only symbol, in one bit.
AC_LENGTHS = [1] + [0] * 15
AC_SYMBOLS = [0]


def _codes(lengths: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a Huffman table, shortest first."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, bits))
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """symbol * 32 + bits for every 16 bits that may come next; 0 if they are no code."""
    table = np.zeros(1 << 16, np.int64)
    for s, code, bits in _codes(list(lengths), list(symbols)):
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = s * 32 + bits
    return table


@lru_cache(maxsize=1)
def _flat_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference of -255 to 255: category, magnitude, end of block."""
    codes = {s: (code, bits) for s, code, bits in _codes(DC_LENGTHS, DC_SYMBOLS)}
    bits, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, n = codes[c]
        bits[d + 255] = ((code << c | (d if d > 0 else d + (1 << c) - 1 if d else 0)) << 1) | 0
        length[d + 255] = n + c + 1
    return bits, length


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    dims = (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big")
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, b"\0" + bytes([8] * 64)),
            _segment(0xC0, b"\x08" + dims + b"\1\1\x11\0"),
            _segment(0xC4, b"\x00" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, ROW.to_bytes(2, "big")),
            _segment(0xDA, b"\1\1\0\0\x3f\0"),
        ]
    )


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def stored(payloads: list[bytes]) -> list[bytes]:
    """Each payload (of a multiple of 64 bytes) as JPEGs."""
    files: list[list[bytes]] = [[] for _ in payloads]
    todo, size = [], 0
    for i, p in enumerate(payloads):
        for at in range(0, len(p), MAX_ROWS * ROW):
            todo.append((i, p[at : at + MAX_ROWS * ROW]))
            size += len(todo[-1][1])
            if size >= BATCH_BYTES:
                _store(todo, files)
                todo, size = [], 0
    if todo:
        _store(todo, files)
    return [b"".join(f) for f in files]


def _store(images: list[tuple[int, bytes]], files: list[list[bytes]]) -> None:
    level = np.frombuffer(b"".join(p for _, p in images), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0)) + np.int16(255)
    bits, length = _flat_codes()
    code, n = bits[diff], length[diff]
    ends = np.cumsum(n, axis=1)
    size = (ends[:, -1] + 7) >> 3
    start = np.r_[0, np.cumsum(size)]
    at = ((start[:-1] << 3)[:, None] + ends - n).ravel()
    three = code.ravel() << (24 - n.ravel() - (at & 7))
    at >>= 3
    total = int(start[-1])
    raw = sum(np.bincount(at + k, (three >> (16 - 8 * k)) & 255, total + 3)[:total] for k in range(3)).astype(np.uint8)
    raw[start[1:] - 1] |= ((1 << ((size << 3) - ends[:, -1])) - 1).astype(np.uint8)  # ones fill a row's last byte
    # a zero after each byte of ones; a marker after each row
    ones = raw == 0xFF
    where = np.arange(total) + np.cumsum(ones) - ones + 2 * np.repeat(np.arange(len(size)), size)
    out = np.zeros(total + int(ones.sum()) + 2 * len(size), np.uint8)
    out[where] = raw
    marks = np.r_[where[start[1:-1]] - 2, len(out) - 2]
    rows = np.array([len(p) // ROW for _, p in images])
    last = np.cumsum(rows) - 1
    number = np.arange(len(size)) - np.repeat(np.r_[0, last[:-1] + 1], rows)
    out[marks], out[marks + 1] = 0xFF, 0xD0 + (number & 7)
    out[marks[last] + 1] = 0xD9
    cut = np.r_[0, marks[last] + 2].tolist()
    for k, (i, _) in enumerate(images):
        files[i] += [_header(int(rows[k])), out[cut[k] : cut[k + 1]].tobytes()]


@dataclass
class Scan:
    """What a baseline file says about its luminance, and where its scan's bytes are."""

    width: int
    height: int
    blocks: tuple[tuple[int, int, int], ...]  # component, DC table, AC table of each block of an MCU
    grid: tuple[int, int, int, int]  # MCUs across and down, luminance blocks across and down in each
    tables: tuple  # lookups' keys by (class, number)
    quantiser: int
    interval: int  # MCUs between restart markers; 0: none
    data: bytes = b""
    levels: np.ndarray | None = field(default=None)


class NotBaseline(ValueError):
    pass


def parsed(data: bytes) -> list[Scan]:
    """The scans of the baseline JPEGs that follow each other in `data`."""
    out, at = [], 0
    while at < len(data):
        scan, at = _parse_one(data, at)
        out.append(scan)
    return out


def _parse_one(data: bytes, at: int) -> tuple[Scan, int]:
    if data[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at += 2
    quant: dict[int, int] = {}
    huff: dict[tuple[int, int], tuple] = {}
    frame, interval = None, 0
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise NotBaseline("no marker where one must be")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                lengths = tuple(body[1:17])
                n = sum(lengths)
                huff[body[0] >> 4, body[0] & 15] = (lengths, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise NotBaseline("samples of 8 bits only")
            frame = (int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])])
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise NotBaseline("not a baseline frame")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
        elif marker == 0xD9:
            raise NotBaseline("no scan")
    if frame is None or not frame[0] or not frame[1]:
        raise NotBaseline("no frame")
    height, width, comps = frame
    picked = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if [c[0] for c in comps if c[0] in picked] != [c[0] for c in comps]:
        raise NotBaseline("components in scans of their own")
    hmax, vmax = max(c[1] >> 4 for c in comps), max(c[1] & 15 for c in comps)
    if len(comps) == 1:
        hmax = vmax = 1
    blocks = tuple((i, picked[c[0]] >> 4, picked[c[0]] & 15) for i, c in enumerate(comps) for _ in range(1 if len(comps) == 1 else (c[1] >> 4) * (c[1] & 15)))
    luma = (1, 1) if len(comps) == 1 else (comps[0][1] >> 4, comps[0][1] & 15)
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise NotBaseline("no end of image")
        if data[end + 1] == 0xD9:
            break
        if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
            raise NotBaseline("more than one scan")
        end += 2
    grid = (-(-width // (8 * hmax)), -(-height // (8 * vmax)), *luma)
    return Scan(width, height, blocks, grid, tuple(sorted(huff.items())), quant[comps[0][2]], interval, data[at:end]), end + 2


def _decode(scans: list[Scan]) -> None:
    """Fills in the DC levels of scans that have the same blocks, tables and interval."""
    first = scans[0]
    raw = np.frombuffer(b"".join(s.data + b"\xff\xd9" for s in scans), np.uint8)
    ones = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ones + 1]
    keep = np.ones(len(raw), bool)
    keep[ones[after == 0] + 1] = False
    marks = ones[after >= 0xD0]
    keep[marks] = keep[marks + 1] = False
    clean = np.r_[raw[keep], np.zeros(16, np.uint8)]
    place = np.cumsum(keep)
    lane_end = place[marks]
    pos = np.r_[0, lane_end[:-1]].astype(np.int64) << 3
    limit = lane_end << 3
    window = np.zeros(len(clean) - 8, np.uint64)
    for k in range(8):
        window |= clean[k : k + len(window)].astype(np.uint64) << np.uint64(56 - 8 * k)
    per_scan = [s.grid[0] * s.grid[1] for s in scans]
    lanes, mcus = [], []
    for n in per_scan:
        k = -(-n // first.interval) if first.interval else 1
        lanes.append(k)
        mcus += [first.interval or n] * (k - 1) + [n - (first.interval or n) * (k - 1)]
    if len(mcus) != len(pos):
        raise NotBaseline("restart markers are missing")
    mcus_of = np.array(mcus)
    order = np.argsort(-mcus_of, kind="stable")
    pos, limit, left = pos[order], limit[order], mcus_of[order]
    tables = dict(first.tables)
    luma = first.grid[2] * first.grid[3]
    found = np.zeros((len(pos), int(left[0]), luma), np.int32)
    pred = np.zeros((len(pos), 1 + max(b[0] for b in first.blocks)), np.int64)

    def look(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = window[np.minimum(at >> 3, len(window) - 1)] << (at & 7).astype(np.uint64)
        x = table[(w >> np.uint64(48)).astype(np.int64)]
        return w, x >> 5, x & 31

    for m in range(int(left[0])):
        on = int(np.searchsorted(-left, -m, "left"))  # lanes that have an MCU number m, the first ones
        p = pos[:on]
        nth = 0
        for comp, dc, ac in first.blocks:
            w, size, bits = look(p, _lookup(*tables[0, dc]))
            if not bits.all():
                raise NotBaseline("no such code")
            n = size.astype(np.uint64)
            value = np.where(size > 0, ((w << bits.astype(np.uint64)) >> (np.uint64(64) - np.maximum(n, np.uint64(1)))).astype(np.int64), 0)
            value -= np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), (1 << size) - 1, 0)
            pred[:on, comp] += value
            p += bits + size
            if comp == 0:
                found[:on, m, nth] = pred[:on, 0]
                nth += 1
            table = _lookup(*tables[1, ac])
            _, rs, bits = look(p, table)
            done = (rs == 0) & (bits > 0)
            p += np.where(done, bits, 0)
            rest = np.flatnonzero(~done)
            k = np.ones(len(rest), np.int64)
            while len(rest):
                q = p[rest]
                _, rs, bits = look(q, table)
                if not bits.all():
                    raise NotBaseline("no such code")
                p[rest] = q + bits + (rs & 15)
                k += np.where(rs == 0, 64, (rs >> 4) + 1)
                more = k < 64
                rest, k = rest[more], k[more]
        pos[:on] = p
    if (pos > limit).any():
        raise NotBaseline("the scan ends too early")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    found = found[back]
    at = 0
    for s, n, k in zip(scans, per_scan, lanes, strict=True):
        across, down, h, v = s.grid
        flat = found[at : at + k].reshape(-1, luma)[:n]  # only a scan's last interval may be short
        at += k
        grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        grid = grid[: -(-s.height // 8), : -(-s.width // 8)] if (s.height, s.width) != (0, 0) else grid
        s.levels = np.clip((grid * s.quantiser + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnails(files: list[bytes | None]) -> list[list[Scan] | str | None]:
    """The scans of each file with their levels, or what is wrong with it; null files: null."""
    out: list[list[Scan] | str | None] = []
    groups: dict[tuple, list[tuple[int, Scan]]] = {}
    for i, data in enumerate(files):
        try:
            out.append(parsed(data) if data is not None else None)
        except (NotBaseline, IndexError, KeyError) as e:
            out.append(f"not a baseline JPEG: {e}")
        for s in out[-1] if isinstance(out[-1], list) else []:
            groups.setdefault((s.blocks, s.tables, s.interval, s.grid[2:]), []).append((i, s))
    for group in groups.values():
        part, size = [], 0
        for n, (i, s) in enumerate(group):
            part.append((i, s))
            size += len(s.data)
            if size >= BATCH_BYTES or n == len(group) - 1:
                try:
                    _decode([x for _, x in part])
                except (NotBaseline, IndexError, KeyError):
                    for j, x in part:  # one bad file must not spoil the others
                        try:
                            _decode([x])
                        except (NotBaseline, IndexError, KeyError) as e:
                            out[j] = f"not a baseline JPEG: {e}"
                part, size = [], 0
    return out


def thumbnail_hash(levels: np.ndarray) -> str:
    """64 bits as hex: for each cell of an 8x8 grid of means, whether it is above the mean of all."""
    rows, cols = (np.arange(9) * n // 8 for n in levels.shape)
    total = np.zeros((levels.shape[0] + 1, levels.shape[1] + 1))
    total[1:, 1:] = levels.cumsum(0, dtype=np.float64).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], levels.shape[0] - 1), None
    r1 = np.maximum(rows[1:], r0 + 1)
    c0 = np.minimum(cols[:-1], levels.shape[1] - 1)
    c1 = np.maximum(cols[1:], c0 + 1)
    mean = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / ((r1 - r0)[:, None] * (c1 - c0)[None])
    return np.packbits(mean > mean.mean()).tobytes().hex()


def with_media(docs: DataFrame, text_col: str = "text", *, out_col: str = "media") -> DataFrame:
    """`docs` with out_col (binary): the whole text's UTF-8, padded with bytes 0 to a positive multiple of 64, as JPEG.

    A null text is stored like an empty one. Rows stay as they are; an out_col that is there already is replaced.
    """
    kept = [c for c in docs.columns if c != out_col]

    def store(batches):
        for b in sliced(batches, text_at):
            payloads = [padded((t or "").encode()) for t in b.column(text_at).to_pylist()]
            yield pa.record_batch([*(b.column(i) for i in range(len(kept))), pa.array(stored(payloads), pa.binary())], names=names)

    source = docs.select(*kept) if text_col in kept else docs.select(*kept, text_col)
    text_at, names = source.columns.index(text_col), [*kept, out_col]
    return source.mapInArrow(store, T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())]))


#: What `read_media` adds.
READ = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("thumbnail", T.BinaryType()), T.StructField("thumbnail_hash", T.StringType()), T.StructField("media_error", T.StringType())])


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """`media` with width and height (of JPEGs one after the other: the first's width, all heights), thumbnail (binary:
    the luminance levels of all blocks, row by row), thumbnail_hash and media_error.

    Null, for files that aren't baseline JPEGs (with media_error) and for null files. Columns of those names are
    replaced; rows stay as they are.
    """
    kept = [c for c in media.columns if c not in READ.names]
    media_at, names = kept.index(media_col), [*kept, *READ.names]

    def read(batches):
        for b in sliced(batches, media_at):
            cols: list[list] = [[] for _ in READ]
            for x in thumbnails(b.column(media_at).to_pylist()):
                if not isinstance(x, list):
                    row = (None, None, None, None, x)
                else:
                    row = (x[0].width, sum(s.height for s in x), b"".join(s.levels.tobytes() for s in x), "-".join(thumbnail_hash(s.levels) for s in x), None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            yield pa.record_batch([*(b.column(i) for i in range(len(kept))), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return media.select(*kept).mapInArrow(read, T.StructType([*(media.schema[c] for c in kept), *READ]))


def digests(docs: DataFrame) -> DataFrame:
    """What storing and reading back give, per document: see `op3_baseline_jpeg`."""
    media = fresh(docs, "media")
    own = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    back = read_media(with_media(own, out_col=media).drop("text"), media)
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -64, 64)).alias("tail_crc32"),
        F.octet_length(media).cast("long").alias("media_bytes"),
        F.sha2(media, 256).alias("media_sha256"),
        F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature"),
    )


def op3_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as baseline JPEGs and read back: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256 and feature (dimensions and thumbnail hash)."""
    return digests(documents(spark, sf_dir))

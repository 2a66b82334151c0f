"""Archives of records (path, body) in binary files, for exchange with other programs; tables are the native form.

Both ways go through Spark's own text source, so that archives may stand in any store that Spark reaches: a record is written as a
"line" whose end is the byte that ends a record, and archives are split and read at the two bytes between records.

These two bytes may also stand within a record, and archives may be damaged, so what stands between them is put together again
split by split. Where in a split its first own record begins, only what stands before can tell. All splits are looked at as if they
began with a record; the few whose last record goes on in the next one say so, and are looked at again with what follows. Then each
task hands on its splits' records, and the pieces of those that lie across splits are joined.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import splits

# Fixed values of the format: the magic and version, and the bytes before and after a record. Numbers are big-endian.
MAGIC, VERSION = b"BONS", b"\x00\x01"
STX, ETX = 2, 3
#: Bytes of bodies that are handed on together.
BATCH_BYTES = 8 << 20
#: What is fetched of the next split if a record's head is cut.
HEAD_BYTES = 1 << 16


def packed(path: str, body: bytes) -> bytes:
    name = path.encode()
    return struct.pack(">BI", STX, len(name)) + name + struct.pack(">Q", len(body)) + body + bytes([ETX])


class _Walk(NamedTuple):
    """Where reading goes on, and the record that goes beyond the bytes at hand: where it begins and its last byte (-1: not
    known, since its head is cut)."""

    at: int
    open_at: int | None = None
    open_end: int = -1


def _records(data: memoryview, limit: int, base: int, entry: int, size: int, bad: frozenset[int]) -> Iterator[tuple[str, int, int, int] | _Walk]:
    """The records in a part of an archive, `limit` bytes of the data, which begins at byte `base` of `size`, from byte `entry` on:
    path, first byte, and where the body begins and ends in the data; at last where to go on. After a damaged one, reading goes on
    at the next byte that may begin a record. bad: records that go beyond the part and have proved to be damaged."""
    at = max(entry - base, 0)
    while at < limit:
        start, head = at + base, bytes(data[at : at + 5])
        name_end = at + 5 + (struct.unpack(">I", head[1:])[0] if len(head) == 5 else 0)
        ok = head[0] == STX and start not in bad and name_end + base + 8 < size
        if ok and (len(head) < 5 or name_end + 8 > len(data)):
            if base + len(data) < size and name_end - at <= HEAD_BYTES:
                yield _Walk(start, start, -1)
                return
            ok = False
        if ok:
            (length,) = struct.unpack_from(">Q", data, name_end)
            end = name_end + 8 + length
            ok = end + base < size
            try:
                path = bytes(data[at + 5 : name_end]).decode()
            except UnicodeDecodeError:
                ok = False
        if ok and end >= limit:
            yield _Walk(end + base + 1, start, end + base)
            return
        if ok and data[end] == ETX:
            yield path, start, name_end + 8, end
            at = end + 1
        else:
            at = _next(data, at + 1)
            if at < 0:
                break
    yield _Walk(base + max(limit, entry - base))


def _next(data: memoryview, at: int) -> int:
    """The next byte that may begin a record, -1 if there is none."""
    for i in range(at, len(data), BATCH_BYTES):
        found = bytes(data[i : i + BATCH_BYTES]).find(bytes([STX]))
        if found >= 0:
            return i + found
    return -1


def unpacked(data: bytes | memoryview) -> Iterator[tuple[str, bytes]]:
    """The records of an archive, one by one. After a damaged one, reading goes on at the next byte that may begin a record."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not an archive")
    view = memoryview(data)
    for r in _records(view, len(view), 0, 6, len(view), frozenset()):
        if not isinstance(r, _Walk):
            yield r[0], bytes(view[r[2] : r[3]])


class _Split(NamedTuple):
    """What is known of a split: its first byte (of what its pieces are) and the one after its last, the size of the file,
    where its first own record begins, the record that reaches into it (-1: none), damaged ones, and what follows it."""

    base: int
    end: int
    size: int
    entry: int
    owner: int = -1
    bad: frozenset[int] = frozenset()
    after: bytes = b""


_Known = dict[tuple[str, int], _Split]


def _whole(batches, names: _Known | None = None) -> Iterator[tuple[tuple[str, int], bytearray]]:
    """Splits, and their bytes: the pieces with the two bytes between them. Others than those named are left out. A split is held
    once, as it grows."""
    at: tuple[str, int] | None = None
    data, n = bytearray(), 0
    for b in batches:
        for p, s, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if (p, s) != at:
                if n:
                    data.append(ETX)
                    yield at, data
                at, data, n = (p, s), bytearray() if s == 0 else bytearray([STX]), 0
            if names is None or at in names:
                if n:
                    data += bytes([ETX, STX])
                data += memoryview(piece.as_buffer())
                n += 1
    if n:
        data.append(ETX)
        yield at, data


def _view(data: bytearray, own: int, after: bytes) -> memoryview:
    """A split's own bytes and what is known of those after it; copied only where something is."""
    return memoryview(bytes(data[:own]) + after) if after else memoryview(data)[:own]


def _starts(pieces: DataFrame) -> _Known:
    """All splits, in order, as if each began with a record. One row a split comes to the driver, where Spark has planned them."""
    rows = pieces.groupBy("path", "split", "size").agg(F.sum(F.octet_length("piece") + 2).alias("n")).orderBy("path", "split").collect()
    known: _Known = {}
    path, end = None, 0
    for r in rows:
        base = 0 if r["path"] != path else end
        # the last byte of the first split's last pair begins the next split
        path, end = r["path"], base + r["n"] - (r["split"] == 0)
        known[r["path"], r["split"]] = _Split(base, min(end, r["size"]), r["size"], base + 6 if base == 0 else base)
    return known


def _walked(pieces: DataFrame, known: _Known) -> dict[tuple[str, int], _Walk]:
    """Of the splits named: where their last record ends."""
    sent = pieces.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for key, data in _whole(batches, sent.value):
            s = sent.value[key]
            own = s.end - s.base
            view = _view(data, own, s.after)
            if s.base == 0 and bytes(view[:4]) != MAGIC:
                raise ValueError(f"{key[0]} is not an archive")
            *_, last = _records(view, own, s.base, s.entry, s.size, s.bad)
            yield pa.record_batch([pa.array([key[0]]), *(pa.array([x], pa.int64()) for x in (key[1], last.at, last.open_at, last.open_end))], names=["path", "split", "at", "open_at", "open_end"])

    rows = pieces.select("path", "split", "piece").mapInArrow(run, "path string, split long, at long, open_at long, open_end long").collect()
    return {(r["path"], r["split"]): _Walk(r["at"], r["open_at"], r["open_end"]) for r in rows}


def _bytes_at(pieces: DataFrame, known: _Known, wanted: dict[tuple[str, int], list[tuple[int, int]]]) -> dict[tuple[str, int], bytes]:
    """Some bytes (place in the file, number) of splits, by split and place."""
    sent = pieces.sparkSession.sparkContext.broadcast((wanted, {k: known[k].base for k in wanted}))

    def run(batches):
        places, bases = sent.value
        for key, data in _whole(batches, places):
            for at, n in places[key]:
                yield pa.record_batch([pa.array([key[0]]), pa.array([at], pa.int64()), pa.array([bytes(data[at - bases[key] : at - bases[key] + n])], pa.binary())], names=["path", "at", "bytes"])

    rows = pieces.select("path", "split", "piece").mapInArrow(run, "path string, at long, bytes binary").collect()
    return {(r["path"], r["at"]): bytes(r["bytes"]) for r in rows}


def _settled(pieces: DataFrame) -> _Known:
    """Where each split's first own record begins. Splits whose last record ends with them, all of them as a rule, are looked at
    once; those after others again, all of them together, until nothing changes: what is known of a split is right once all
    before it are, and mostly at once, since reading finds into step by itself."""
    known = _starts(pieces)
    order = list(known)
    number = {k: i for i, k in enumerate(order)}
    after = {k: nxt for k, nxt in zip(order, order[1:], strict=False) if nxt[0] == k[0]}
    found = _walked(pieces, known)
    got: dict[tuple[str, int], bytes] = {}
    while True:
        again: _Known = {}
        # heads that are cut, and records that go on: do they end as records do?
        wanted: dict[tuple[str, int], list[tuple[int, int]]] = {}
        asked = []
        for k, w in found.items():
            if w.open_at is not None and k in after:
                at = w.open_end if w.open_end >= 0 else known[after[k]].base
                asked.append((k, w, at))
                if (k[0], at) not in got:
                    there = after[k]
                    while there in after and known[there].end <= at:
                        there = order[number[there] + 1]
                    if known[there].base <= at < known[there].end:
                        wanted.setdefault(there, []).append((at, 1 if w.open_end >= 0 else HEAD_BYTES + 16))
                    got[k[0], at] = b""
        got |= _bytes_at(pieces, known, wanted) if wanted else {}
        for k, w, at in asked:
            s = known[k]
            if w.open_end < 0 and not s.after and got[k[0], at]:
                again[k] = s._replace(after=got[k[0], at])
            elif w.open_end < 0 or got[k[0], at][:1] != bytes([ETX]):
                again[k] = s._replace(bad=s.bad | {w.open_at})
        if not again:  # how far records reach into the splits after theirs
            path, to, owner = None, 0, -1
            for k in order:
                path, to, owner = (path, to, owner) if k[0] == path else (k[0], 0, -1)
                s, w = known[k], found[k]
                entry, own = (to, owner) if to > s.base else ((s.base + 6 if s.base == 0 else s.base), -1)
                if (entry, own) != (s.entry, s.owner):
                    again[k] = s._replace(entry=entry, owner=own, bad=frozenset())
                if entry < s.end:
                    to, owner = (w.open_end + 1, w.open_at) if w.open_at is not None else (0, -1)
        if not again:
            return known
        known |= again
        found |= _walked(pieces, again)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path and body of all records of the archives under a path, in any store that Spark reads; a large archive in many tasks.
    Damaged records are left out. A file that doesn't begin as an archive raises an error; empty files hold nothing."""
    pieces = splits(spark, path, end=bytes([ETX, STX]).decode())
    sent = spark.sparkContext.broadcast(_settled(pieces))

    def run(batches):
        """Whole records, with file null; and pieces of those across splits: their file, first byte and place."""
        names = ["path", "body", "file", "first", "at"]
        for key, data in _whole(batches):
            s = sent.value[key]
            own = s.end - s.base
            view = memoryview(data[:own])
            out: list[tuple] = []
            size = 0
            if s.owner >= 0:
                out.append((None, bytes(view[: s.entry - s.base]), key[0], s.owner, s.base))
            for r in _records(_view(data, own, s.after), own, s.base, s.entry, s.size, s.bad):
                if isinstance(r, _Walk):
                    if r.open_at is not None:
                        out.append((None, bytes(view[r.open_at - s.base :]), key[0], r.open_at, r.open_at))
                else:
                    body = bytes(view[r[2] : r[3]])
                    out.append((r[0], body, None, None, None))
                    size += len(body)
                if size >= BATCH_BYTES:
                    yield _batch(out, names)
                    out, size = [], 0
            yield _batch(out, names)

    def across(batches):
        for b in batches:
            whole = [next(unpacked(MAGIC + VERSION + d), (None, None)) for d in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([p for p, _ in whole], pa.string()), pa.array([d for _, d in whole], pa.binary())], names=["path", "body"])

    rows = pieces.select("path", "split", "piece").mapInArrow(run, "path string, body binary, file string, first long, at long")
    found = rows.where("file is null").select("path", "body")
    if not any(s.owner >= 0 for s in sent.value.values()):
        return found
    # the pieces of one record, which is a value of 2 GB at most
    parts = rows.where("file is not null").groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
    whole = parts.select(F.aggregate("parts", F.lit(b""), lambda all_of_it, p: F.concat(all_of_it, p["body"])).alias("body"))
    return found.unionByName(whole.mapInArrow(across, "path string, body binary").where("path is not null"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def write_archives(records: DataFrame, folder: str) -> None:
    """Records (path, body; null: empty) as archives, one for each partition that has any, in any store that Spark writes to.
    Spark commits the files as those of any table."""

    def number(n, size: int):
        return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))

    name, body = F.encode(F.coalesce("path", F.lit("")), "UTF-8"), F.coalesce("body", F.lit(b""))
    head = F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, F.lit(MAGIC + VERSION)).otherwise(F.lit(b""))
    record = F.concat(head, F.lit(bytes([STX])), number(F.octet_length(name), 4), name, number(F.octet_length(body), 8), body)
    # the end of a "line" is the byte that ends a record
    records.select(record.cast("string").alias("value")).write.mode("append").option("lineSep", bytes([ETX]).decode()).text(folder)

"""Word hashes and sets of word shingles, many texts at a time in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of texts that are hashed together.
GROUP_BYTES = 1 << 20
#: Powers that a worker keeps from one call to the next, at most.
KEPT_POWERS = 5 * GROUP_BYTES // 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits mixed well, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64; those for usual lengths are kept."""
    if len(_powers[0]) < n:
        made = [np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, base)]) for base in (_ODD, _ODD_INVERSE)]
        if n > KEPT_POWERS:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text, a 64-bit hash of every word `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; null: no words."""
    for group in groups(texts):
        if len(group[0]) > GROUP_BYTES:
            yield _of_long(group[0])
            continue
        hashes, _, cut = hashed(group)
        for i in range(len(group)):
            yield hashes[cut[i] : cut[i + 1]]


def _of_long(raw: bytes) -> np.ndarray:
    """The word hashes of a long text, looked at in pieces; memory for the rest doesn't grow with it or with its words."""
    out, at = [], 0
    while at < len(raw):
        white = _SPACE.search(raw, min(at + GROUP_BYTES, len(raw)))
        end = white.start() if white else len(raw)
        long = end if end - at <= 2 * GROUP_BYTES else max(at, *(raw.rfind(bytes([w]), at, at + GROUP_BYTES) + 1 for w in np.flatnonzero(_WHITE)))
        out.append(hashed([raw[at:long]])[0])
        if long < end:  # a word of more than a piece
            total = 0
            for i in range(long, end, GROUP_BYTES):
                piece = np.frombuffer(raw, np.uint8, min(GROUP_BYTES, end - i), i)
                total += int((_BYTE[piece] * powers(len(piece))[0][: len(piece)]).sum()) * pow(int(_ODD), i - long, 1 << 64)
            out.append(mixed(np.array([(total + end - long) % (1 << 64)], np.uint64)))
        at = end
    return np.concatenate(out)


def groups(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """The texts' UTF-8, A-Z in lower case, about a megabyte at a time; a longer text by itself."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        if group and size + len(raw) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield group


def hashed(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the number of each one's line, counted over the group, and the words before each text."""
    raw = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    up, down = powers(len(raw) + 1)
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * up[: len(raw)])]
    edge = np.diff(np.r_[True, _WHITE[raw]].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    at = np.r_[0, np.cumsum([len(b) + 1 for b in group], dtype=np.int64)]
    return hashes, np.searchsorted(np.flatnonzero(raw == 10), start), np.searchsorted(start, at)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes, in ascending order, of the runs of k words; with fewer words, of the whole sequence."""
    n = min(k, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, np.uint64(n))
    for j in range(n):
        out = out * _ODD + words[j : len(words) - n + 1 + j]
    return np.unique(mixed(out))

import random

import numpy as np
import pytest

from tessera.llm import jpeg

SCHEMA = "doc_id long, text string, media string, width string"


def test_round_trip(spark):
    rng = random.Random(5)
    values = ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x7FF), rng.randint(0x4E00, 0x9FFF), 0x1F642])) for _ in range(rng.choice([1, 20, 63, 64, 65, 700]))) for _ in range(60)]
    values += [None, "", "x" * 64, "\x00" * 65, "ÿ" * 1000, "long text " * 70_000, values[0]]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(values)], SCHEMA)
    back = {r["doc_id"]: r for r in jpeg.read_media(jpeg.with_media(docs)).collect()}
    for i, t in enumerate(values):
        payload = jpeg.padded((t or "").encode())
        assert bytes(back[i]["thumbnail"]) == payload and len(payload) % 64 == 0 and payload
        assert (back[i]["width"], back[i]["height"], back[i]["media_error"]) == (512, len(payload) // 8, None)
        assert bytes(back[i]["media"])[:2] == b"\xff\xd8" and bytes(back[i]["media"])[-2:] == b"\xff\xd9"
    assert back[0]["thumbnail_hash"] == back[len(values) - 1]["thumbnail_hash"]


def test_more_rows_than_a_jpeg_may_have(monkeypatch):
    monkeypatch.setattr(jpeg, "MAX_ROWS", 3)
    payload = bytes(range(256)) * 4
    (scans,) = jpeg.thumbnails(jpeg.stored([payload]))
    assert len(scans) == 6 and b"".join(s.levels.tobytes() for s in scans) == payload


@pytest.mark.parametrize("bad", [b"", b"\xff\xd8", b"not an image", jpeg.stored([bytes(64)])[0][:-3], b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"])
def test_bad_files_are_told(bad):
    good = jpeg.stored([bytes(64)])[0]
    first, second, third = jpeg.thumbnails([good, bad, None])
    assert first[0].levels.tobytes() == bytes(64) and third is None
    assert (isinstance(second, str) and "not a baseline JPEG" in second) or second == []


def test_hash_follows_the_picture():
    ramp = np.arange(64, dtype=np.uint8)[None].repeat(16, 0)
    assert jpeg.thumbnail_hash(ramp) == "0f" * 8
    assert jpeg.thumbnail_hash(ramp[:1]) == "0f" * 8


def test_empty_table(spark):
    assert jpeg.digests(spark.createDataFrame([], SCHEMA)).collect() == []


def encoded(rng, width, height, sampling, interval, quantiser):
    """A baseline JPEG written bit by bit, with chroma, subsampling and AC coefficients, and the DC levels of its luma."""
    symbols = [list(range(12)), [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]]
    lengths = [5, 9]  # of all codes of a table; the one of all ones stays free

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    hmax, vmax = sampling[0]
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    out, bits = b"", []

    def put(value, n):
        bits.extend(value >> i & 1 for i in reversed(range(n)))

    def flushed():
        nonlocal bits
        bits += [1] * (-len(bits) % 8)
        data = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        bits = []
        return data.replace(b"\xff", b"\xff\x00")

    def number(value):
        n = abs(value).bit_length()
        return n, value if value > 0 else value + (1 << n) - 1

    luma = np.zeros((down * vmax, across * hmax), int)
    before = [0, 0, 0]
    for m in range(across * down):
        if interval and m and m % interval == 0:
            out += flushed() + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            before = [0, 0, 0]
        for c, (h, v) in enumerate(sampling):
            for b in range(h * v):
                dc = rng.randint(-60, 60)
                if c == 0:
                    luma[m // across * v + b // h, m % across * h + b % h] = dc
                n, value = number(dc - before[c])
                before[c] = dc
                put(symbols[0].index(n), lengths[0])
                put(value, n)
                k = 1
                while k < 64 and rng.random() < 0.7:
                    run = rng.choice([0, 0, 1, 5, 17, 40])
                    if k + run > 63:
                        break
                    for _ in range(run // 16):
                        put(symbols[1].index(0xF0), lengths[1])
                    n, value = number(rng.choice([-900, -3, -1, 1, 2, 700]))
                    put(symbols[1].index(run % 16 << 4 | n), lengths[1])
                    put(value, n)
                    k += run + 1
                if k < 64:
                    put(symbols[1].index(0x00), lengths[1])
    out += flushed()
    tables = b"".join(bytes([kind << 4 | i]) + bytes(len(symbols[kind]) if n + 1 == lengths[kind] else 0 for n in range(16)) + bytes(symbols[kind]) for kind in (0, 1) for i in (0, 1))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3]) + b"".join(bytes([c + 1, h << 4 | v, c > 0]) for c, (h, v) in enumerate(sampling))
    scan = bytes([3]) + b"".join(bytes([c + 1, (c > 0) * 0x11]) for c in range(3)) + bytes([0, 63, 0])
    quant = b"".join(bytes([i]) + bytes([quantiser + i] * 64) for i in (0, 1))
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\x00 and more") + segment(0xDB, quant) + segment(0xC4, tables) + (segment(0xDD, interval.to_bytes(2, "big")) if interval else b"")
    levels = np.clip((luma * quantiser + 4 >> 3) + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]
    return head + segment(0xFE, b"a comment") + segment(0xC0, frame) + segment(0xDA, scan) + out + b"\xff\xd9", levels


@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(2, 2), (2, 1), (1, 2)]])
@pytest.mark.parametrize("interval", [0, 3])
def test_files_with_chroma_and_ac_coefficients(sampling, interval):
    rng = random.Random(str((sampling, interval)))
    files, want = zip(*(encoded(rng, w, h, sampling, interval, q) for w, h, q in ((64, 48, 4), (61, 33, 7), (8, 8, 3), (200, 17, 16))), strict=True)
    for (scan,), levels in zip(jpeg.thumbnails(list(files)), want, strict=True):
        assert scan.levels.shape == levels.shape and (scan.levels == levels).all()

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm
from tessera.llm.lm import BINS, FIRST_BLOCK, GATES, KINDS, LAST_BLOCK, LONG_BYTES, START_WEIGHTS, STEPS, Mixer, huffman, scored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, bits string")


def test_base_score_and_learning(spark):
    train = ["The cat sat on the mat. " * 20, "the dog sat on the log\n" * 30, None, "", "é è"]
    texts = ["the cat sat on the log. " * 5, "xq zzk wvv jjq kqx " * 6, None, "", "The the", "the\x0bcat " * 40_000, "the cat sat on the log. " * 5]
    out = {r["doc_id"]: r for r in scored(table(spark, texts), table(spark, train)).collect()}
    counts = Counter(w for t in train for w in words(t))
    counts[None] = len(train)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        own = [*words(t), None]
        assert out[i]["n_tokens"] == len(own) and out[i]["train_tokens"] == total
        assert out[i]["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(out[i]["base_score"], sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
        assert math.isclose(out[i]["bits_per_byte"] * (len((t or "").encode()) + 1), out[i]["bits"])
    assert out[0]["bits_per_byte"] < 0.5 * out[1]["bits_per_byte"]
    assert out[0]["bits"] == out[6]["bits"] and out[2]["bits"] == out[3]["bits"]


def test_empty_tables(spark):
    none = table(spark, ["a"]).where("false")
    assert scored(none, table(spark, ["a b"])).collect() == []
    row = scored(table(spark, ["a b"]), none).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def slow_contexts(text):
    """Of each byte and the end: two bytes, three bytes and the word so far, as byte strings, and the byte."""
    raw, word = text.encode() + b"\xff", b""
    low = raw.lower()
    for i in range(len(raw)):
        word = b"" if i and low[i - 1 : i].isspace() else word
        yield (low[max(0, i - 2) : i], low[max(0, i - 3) : i], word[-lm.WORD_BYTES :]), len(word), raw[i]
        word += low[i : i + 1]


def slow_counts(texts):
    counts = [{}, {}, {}]
    for t in texts:
        for contexts, _, byte in slow_contexts(t):
            for of, c in zip(counts, contexts, strict=True):
                of.setdefault(c, Counter())[byte] += 1
    return [{c: n for c, n in of.items() if n.total() >= least} for of, least in zip(counts, lm.LEAST_SEEN.values(), strict=True)]


def slow_bits(text, counts, code):
    """The same bit by bit, as it is described."""
    weights, shift = [[w / STEPS for w in START_WEIGHTS] for _ in range(GATES)], [0.0] * BINS
    rows, total, at, size = list(slow_contexts(text)), 0.0, 0, FIRST_BLOCK
    while at < len(rows):
        moved, seen, bins = [[0.0] * 3 for _ in range(GATES)], [0] * GATES, [[0.0, 0] for _ in range(BINS)]
        for contexts, far, byte in rows[at : at + size]:
            gate, own = min(far, GATES - 1), code_before(contexts) << 8
            path = slice(code.start[own | byte], code.start[own | byte] + code.length[own | byte])
            for node, bit in zip(code.node[path], code.bit[path], strict=True):
                x, shorter = [], None
                for of, c in zip(counts, contexts, strict=True):
                    shorter = of.get(c, shorter)
                    sides = [0, 0]
                    for b, n in (shorter or {}).items():
                        nodes = code.node[code.start[own | b] : code.start[own | b] + code.length[own | b]].tolist()
                        if node in nodes:
                            sides[code.bit[code.start[own | b] + nodes.index(node)]] += n
                    x.append(max(-127, min(127, round(math.log((sides[1] + 0.4) / (sides[0] + 0.4)) * STEPS))))
                mix = sum(w * v for w, v in zip(weights[gate], x, strict=True))
                place = int(min(max(mix * 2 + BINS / 2, 0), BINS - 0.5))
                sign = 1 if bit else -1
                e = math.exp(-sign * (mix + shift[place]))
                total += math.log2(1 + e)
                wrong = sign * e / (1 + e)
                seen[gate] += 1
                moved[gate] = [m + wrong * v for m, v in zip(moved[gate], x, strict=True)]
                bins[place][0] += wrong
                bins[place][1] += 1
        for g in range(GATES):
            weights[g] = [w + lm.WEIGHT_RATE / STEPS**2 * m / (seen[g] + 8) for w, m in zip(weights[g], moved[g], strict=True)]
        shift = [s + 4 * lm.BIN_RATE * w / (n + 16) for s, (w, n) in zip(shift, bins, strict=True)]
        at, size = at + size, min(2 * size, LAST_BLOCK)
    return total


def code_of(texts):
    counts = np.zeros((256, 256), int)
    for t in texts:
        for contexts, _, byte in slow_contexts(t):
            counts[code_before(contexts), byte] += 1
    return huffman(counts)


def code_before(contexts):
    return 0 if not contexts[0] or contexts[0][-1:].isspace() else contexts[0][-1]


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_bits_are_those_of_a_slow_mixer(spark, monkeypatch, most):
    """Whether contexts are held by every task or joined makes no difference."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(map(chr, rng.integers(97, 105, rng.integers(1, 9)))) for _ in range(60)] + ["Größe", "THE", "x" * 40]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (3, 40, 150, 400)] + ["", "a", "the\tThe\n the", "unseen words: zzzz"]
    train = texts[:4]
    monkeypatch.setattr(lm, "TOP_CONTEXTS", most)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lm, "RANGE_BYTES", 500)
    got = [r["bits"] for r in scored(table(spark, texts), table(spark, train)).orderBy("doc_id").collect()]
    counts, code = slow_counts(train), code_of(train)
    assert np.allclose(got, [slow_bits(t, counts, code) for t in texts], rtol=2e-4)


def trained(texts):
    """A mixer whose tables hold all contexts of texts."""
    runs = {kind: lm.Runs() for kind in KINDS}
    for part in lm.parts(texts):
        words, three, byte = lm.words_of(part), lm.three_before(part), part.raw[part.lead :]
        runs[1].add(lm.of_bytes(three & np.uint32(0xFFFF)) | byte)
        runs[2].add(lm.of_bytes(three) | byte)
        runs[3].add(words.keys | words.raw, words.times)
    code = code_of(texts)
    return Mixer(code, [lm._table(*runs[kind].all(), code) for kind in KINDS])


def test_a_text_alone_and_in_a_batch_cost_the_same(monkeypatch):
    texts = ["one two three four five " * 50, "", "x" * 9000, "wörter und so weiter " * 7, "Long ones go on and on\n" * 40_000]
    mixer = trained(texts[:4])
    assert len(texts[4]) > 3 * LONG_BYTES
    together = mixer.bits(texts)
    assert np.allclose(together, [mixer.bits([t])[0] for t in texts], rtol=1e-4)
    monkeypatch.setattr(lm, "LONG_BYTES", 1 << 22)
    monkeypatch.setattr(lm, "CODED_BYTES", 1 << 12)
    assert np.allclose(together, mixer.bits(texts), rtol=1e-4)


def test_memory_does_not_grow_with_a_text():
    mixer, peaks = trained(["the cat sat on the mat"]), []
    for n in (2, 20):
        text = "the cat sat on the mat and on\n" * (n * 1_000_000 // 30)
        tracemalloc.start()
        mixer.bits([text])
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * len(text))  # the text in two codings
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 60_000_000


def test_code_lengths_are_those_of_a_prefix_code():
    """All texts of one byte and the end, together, use up no more than all of the code space."""
    mixer = trained(["some text"])
    first = mixer.bits([chr(b) for b in range(128)])
    assert (2.0**-first).sum() <= 1 + 1e-6


def test_contexts_grow_with_the_corpus_and_are_told_apart(spark):
    """Each keeps its own counts, and none is counted twice."""
    rng = np.random.default_rng(3)
    own = [" ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(3000)) for _ in range(2)]
    texts = [*own, *own]  # each context twice at least
    cells = Counter()
    for r in lm.counted(table(spark, texts), 3).where("kind > 0").collect():
        keys, times = lm.unpacked([r["cells"]])
        assert ((keys >> np.uint64(61)) == r["range"]).all()
        for k, n in zip(keys.tolist(), times.tolist(), strict=True):
            cells[r["kind"], k] += n
    want = [n for of in slow_counts(texts) for c in of.values() for n in c.values()]
    assert sorted(cells.values()) == sorted(want) and len(want) > 50_000


def test_words_are_placed_for_scoring_only():
    """Counting and asking leave out what only scoring looks at; different words are told apart by one sort (the query's CPU seconds)."""
    rng = np.random.default_rng(5)
    for keys in (np.zeros(0, np.uint64), rng.integers(0, 9, 200).astype(np.uint64), rng.integers(0, 9, 50).astype(np.uint32)):
        one, back, times = lm._alike(keys)
        own, counts = np.unique(keys, return_counts=True)
        assert (keys[one] == own).all() and (own[back] == keys).all() and (times == counts).all()
    for part in lm.parts(["a b a\n", "", "  b é b", "x" * (lm.LONG_BYTES + 9)]):
        every, few = lm.words_of(part), lm.words_of(part, placed=False)
        for name in ("raw", "keys", "times", "hashes", "word_times"):
            assert (getattr(every, name) == getattr(few, name)).all()

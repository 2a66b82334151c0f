import random

from tessera.llm.lines import MIN_WORDS, NEAR_WORDS, deduplicated, within_one

SCHEMA = "doc_id long, text string, n_lines string"


def words(line):
    return line.encode().lower().split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept, gone = [], []
        for i, line in enumerate(t.split("\n") if t is not None else []):
            w = words(line)
            again = len(w) >= MIN_WORDS and any(w == x or (min(len(w), len(x)) >= NEAR_WORDS and abs(len(w) - len(x)) < 2 and distance(w, x) < 2) for x in seen)
            if len(w) >= MIN_WORDS:
                seen.append(w)
            gone.append(i) if again else kept.append(line)
        out[d] = ("\n".join(kept) if t is not None else None, gone, len(t.split("\n")) if t is not None else 0)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 10, 11, 14, 25]))] for _ in range(25)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 7)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w).capitalize() + rng.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    rows += [(80, None), (81, ""), (82, "\n\n"), (83, "long " * 30_000), (84, "Long " * 20_000), (None, rows[5][1] + "\nthis line has never been seen before anywhere")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    out = {r["doc_id"]: (r["text"], r["dropped_lines"], r["n_lines"]) for r in deduplicated(docs).collect()}
    assert out == brute(rows)


def test_repeated_rows_are_one_document(spark):
    line = "one two three four five six"
    out = deduplicated(spark.createDataFrame([(1, line, ""), (1, line, ""), (2, line, "")], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, line), (1, line), (2, "")]


def test_empty_table(spark):
    assert deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_within_one():
    a = b"a b c d".split()
    assert all(within_one(a, x.split()) and within_one(x.split(), a) for x in (b"a b c d", b"a c d", b"x b c d", b"a b c x", b"a b c d e", b"x a b c d", b"a b c"))
    assert not any(within_one(a, x.split()) for x in (b"b a c d", b"b c d e", b"a b", b"x b c x", b"a b c d e f"))


def test_texts_that_fill_their_groups_exactly(spark):
    """Batches of every size have the same types, also where the last text ends a group."""
    big = "a line of more than five words\n" * 50_000
    rows = [(i, big if i % 2 else "another line of more than five words", "") for i in range(6)]
    out = deduplicated(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sum(len(r["text"]) > 0 for r in out) == 2

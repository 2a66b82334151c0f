import random
import zlib

from tessera.llm import toxicity
from tessera.llm.toxicity import scored, train, training_rows, windows

RNG = random.Random(8)
PLAIN = ["".join(RNG.choice("aeinrstlo") for _ in range(RNG.randint(2, 9))) for _ in range(900)]
RUDE = ["".join(RNG.choice("bgkpuvwz") for _ in range(7)) for _ in range(12)]


def corpus(n, share=0.3):
    rows = []
    for i in range(n):
        words = [RNG.choice(PLAIN) for _ in range(RNG.randint(20, 200))]
        toxic = RNG.random() < share
        for _ in range(RNG.randint(3, 8) if toxic else 0):
            words[RNG.randrange(len(words))] = RNG.choice(RUDE)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_unseen_documents_are_told_apart(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (1, None), (None, 1), (2, 5)], "doc_id long, toxic int")
    drawn = training_rows(docs, labels)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    own = {t: i for i, t, _ in rows}
    assert drawn and not held & {own[t] for t, _ in drawn}
    assert drawn == training_rows(docs.repartition(5), labels.repartition(3))
    found = {r["doc_id"]: r["toxicity"] for r in scored(docs, train(drawn)).collect()}
    of = {i: y for i, _, y in rows}
    assert sum(found[i] >= 0.5 for i in held if of[i]) >= 0.9 * sum(of[i] for i in held)
    assert sum(found[i] >= 0.5 for i in held if not of[i]) <= 0.05 * sum(not of[i] for i in held)


def test_odd_texts(spark):
    model = train([(t, y) for _, t, y in corpus(300)])
    values = [None, "", "   ", "x" * 300_000, "plain words " * 30_000, RUDE[0] + " " + RUDE[1], "same", "same"]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    found = {r["doc_id"]: r["toxicity"] for r in scored(docs, model).collect()}
    assert len(found) == len(values) and all(0 <= p <= 1 for p in found.values())
    assert found[0] == found[1] == found[2] < 0.5 and found[6] == found[7]
    assert scored(docs.where("false"), model).collect() == []


def test_without_labels_all_count_as_ordinary(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["toxicity"] < 0.5 for r in scored(docs, train(training_rows(docs, none))).collect())


def test_windows_hold_the_whole_text():
    text = "One two\tthree " * 50
    assert b" ".join(w.strip() for w in windows(text)).split() == text.lower().encode().split()
    assert windows(None) == windows(" ") == []


def slow_gains(texts, ordinary, toxic):
    """Window by window with two compressors made from the dictionaries, by the docstring's words."""
    import zstandard as z

    how = {"strategy": z.STRATEGY_LAZY2, "min_match": 4, "window_log": 15, "hash_log": 15, "chain_log": 15, "search_log": 6, "write_content_size": 0, "write_dict_id": 0}
    sizes = []
    for side in (ordinary, toxic):
        params = z.ZstdCompressionParameters.from_level(9, **how)
        sizes.append(lambda x, side=side, params=params: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(side, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(x)))
    out = []
    for t in texts:
        words, runs, run, n = (t or "").encode().lower().split(), [], [], 0
        for w in words:
            run.append(w)
            n += len(w) + 1
            if n >= toxicity.WINDOW_BYTES:
                runs.append(run)
                run, n = [], 0
        runs += [run] if run else []
        found = {}
        for r in runs:
            x = ordinary[-24:] + b" " + b" ".join(r) + b" " + ordinary[-24:][:12]
            gain = sizes[0](x) - sizes[1](x)
            if gain > 0:
                found[gain] = found.get(gain, 0) + 1
        out.append((found, len(runs)))
    return out


def test_gains_like_window_by_window():
    rng = random.Random(8)
    usual = [f"word{i}" for i in range(200)]
    bad = ["vileness", "grimgram", "snarlot"]
    rows = [(" ".join(rng.choices(usual + bad * 5 * y, k=rng.randint(5, 80))), y) for y in [0, 1] * 60]
    model = toxicity.train(rows)
    assert model.ordinary and model.toxic
    texts = [t for t, _ in rows] + [None, "", "É" * 90, "vileness " * 50, "one"]
    assert [(dict(g), n) for g, n in toxicity.gains(texts, model.ordinary, model.toxic)] == slow_gains(texts, model.ordinary, model.toxic)

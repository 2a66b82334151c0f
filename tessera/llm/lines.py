"""Line dedup by a deletion-neighbourhood join over the words of lines.

A line goes if an earlier line, in the order of (doc_id, text hash, line number), has the same words, or, for lines of
`near_words` words or more on both sides, words at an edit distance of one. A-Z in lower case; white space doesn't count.

1. Equal lines are one distinct line with its earliest place; a global sort by that place numbers them, so that the
   smaller number is the earlier line.
2. Two lines at distance one agree in the first or in the last half of their words. Only lines of which another one has
   a half need variants.
3. Those emit their deletion variants as hashed keys: without word i, once with i and the length (two lines that share
   such a key differ by one replaced word), and once without i, together with whole lines (a line that shares it with a
   whole one has one word more). So all lines of a key of the first kind are at distance one or less from each other,
   and those of the second kind from the whole line: the smallest number of a key stands for all, no pairs within keys
   are emitted, and minima are combined before they are shuffled.
4. The edit distance of a line and the earliest that it met is verified on the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, put_back, set_aside, sliced, written
from .shingles import groups, hashed, mixed, powers

MIN_WORDS, NEAR_WORDS = 5, 10
#: Lines, in rows of some 40 bytes, that may be broadcast; more are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Variants in an Arrow batch.
BATCH_ROWS = 1 << 17
_K1, _K2, _K3 = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values times powers; `_of` takes a run's hash from them."""
    return np.r_[np.uint64(0), np.cumsum(values * powers(len(values) + 1)[0][: len(values)])]


def _of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def _lines(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """Every line of min_words or more: its place, two hashes, words n, and keys of its halves (from near_words on)."""
    longs = [T.StructField(c, T.LongType()) for c in ("text_hash", "line_no", "h", "g", "n")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("halves", T.ArrayType(T.LongType()))])

    def lines(batches):
        for b in sliced(batches, 2):
            at = 0
            for group in groups(b.column(2).to_pylist()):
                words, line, cut = hashed(group)
                first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(words) else np.zeros(0, np.int64)
                end = np.r_[first[1:], len(words)][: len(first)]
                n = end - first
                keep = n >= min_words
                first, end, n = first[keep], end[keep], n[keep]
                one, two = _sums(words), _sums(mixed(words ^ _K1))
                doc = np.searchsorted(cut, first, "right") - 1
                newlines = np.r_[0, np.cumsum([x.count(b"\n") + 1 for x in group])]
                u = n.astype(np.uint64)
                near = n >= near_words
                s, e, m = first[near], end[near], n[near]
                halves = []
                for less in (0, 1):
                    h = (m - less) // 2
                    tag = (m - less).astype(np.uint64) * _K2
                    halves += [mixed(_of(one, s, s + h) ^ mixed(tag + np.uint64(1))), mixed(_of(one, e - (m - less - h), e) ^ mixed(tag + np.uint64(2)))]
                flat = np.stack(halves, 1).ravel() if halves else np.zeros(0, np.uint64)
                cols = [mixed(_of(one, first, end) + u * _K2), mixed(_of(two, first, end) + u * _K3)]
                yield pa.record_batch(
                    [
                        b.column(0).take(pa.array(doc + at)),
                        b.column(1).take(pa.array(doc + at)),
                        pa.array(line[first] - newlines[doc]),
                        *(pa.array(c.view(np.int64)) for c in cols),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(4 * near)].astype(np.int32)), pa.array(flat.view(np.int64))),
                    ],
                    names=schema.names,
                )
                at += len(group)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lines, schema)


def _normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen lines (line, and its place): line, words (normalised, separated by blanks)."""
    schema = T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.BinaryType())])

    def texts(batches):
        for b in sliced(batches, 2):
            out = []
            for ids, numbers, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                split = t.encode("utf-8", "surrogatepass").split(b"\n")
                out += [(i, _normal(split[k])) for i, k in zip(ids, numbers, strict=True)]
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=schema.names)

    few = chosen.count() <= BROADCAST_ROWS
    side = chosen.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("line", "line_no")).alias("_at"))
    rows = docs.select("doc_id", "text").join(F.broadcast(side) if few else side, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")))
    return rows.select("_at.line", "_at.line_no", "text").mapInArrow(texts, schema).dropDuplicates(["line"])


def _variants(lines: DataFrame) -> DataFrame:
    """key, line and kind: 0 without word i, by i and length; 1 without word i, to meet 2, a whole line."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("line", T.LongType()), T.StructField("kind", T.IntegerType())])

    def variants(batches):
        for b in sliced(batches, 1):
            ids = b.column(0).to_pylist()
            keys: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            kinds: list[np.ndarray] = []
            size = 0
            words, _, cut = hashed([x.replace(b"\n", b" ") for x in b.column(1).to_pylist()])
            for i, line in enumerate(ids):
                w = words[cut[i] : cut[i + 1]]
                n = len(w)
                sums = _sums(w)
                at = np.arange(n, dtype=np.uint64)
                short = sums[:-1] + (sums[-1] - sums[1:]) * powers(2)[1][1]  # what follows word i moves up by one
                tag = np.uint64(n) * _K2
                keys += [mixed(short ^ mixed(tag + at * _K3)), mixed(short ^ mixed(np.uint64(n - 1) * _K1)), mixed(sums[-1:] ^ mixed(np.uint64(n) * _K1))]
                owners.append(np.full(2 * n + 1, line))
                kinds.append(np.repeat(np.int32([0, 1, 2]), [n, n, 1]))
                size += 2 * n + 1
                if size >= BATCH_ROWS or i == len(ids) - 1:
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(kinds))], names=schema.names)
                    keys, owners, kinds, size = [], [], [], 0

    return lines.select("line", "words").mapInArrow(variants, schema)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word put in, taken out or replaced, or none, makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("line", T.LongType())])

    def verify(batches):
        for b in batches:
            ok = [within_one(x.split(), y.split()) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0).filter(pa.array(ok, pa.bool_()))], names=["line"])

    other = lines.select(F.col("line").alias("partner"), F.col("words").alias("theirs"))
    return pairs.join(lines, "line").join(other, "partner").select("line", "words", "theirs").mapInArrow(verify, schema)


def deduplicated(docs: DataFrame, *, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """`docs` (doc_id, text, ...) without the lines that an earlier one makes superfluous, with n_lines (of the whole
    text) and dropped_lines (their numbers from 0, ascending).

    Lines are what "\\n" separates. Those of fewer than min_words words, blank ones included, always stay. A text that
    loses all its lines becomes empty; a null text stays null (n_lines 0). Null doc_ids come last in the order; rows
    that agree in doc_id and text are one document, and keep the same lines. Columns named n_lines or dropped_lines are
    replaced, others kept. An empty table gives no rows.
    """
    aside, names = set_aside(docs, ["doc_id", "text"], ["n_lines", "dropped_lines"])
    return put_back(_deduplicated(aside, min_words, near_words), names, "n_lines", "dropped_lines")


def _deduplicated(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line_no")
    distinct = _lines(own, min_words, near_words).groupBy("h", "g").agg(F.min(place).alias("at"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    lines = written(distinct.orderBy("at").select(F.monotonically_increasing_id().alias("line"), "at.doc_id", "at.text_hash", "at.line_no", "halves"), "lines-distinct")

    half = lines.select("line", F.explode("halves").alias("key"))
    shared = half.groupBy("key").count().where("count > 1").select("key")
    hopeful = half.join(shared, "key").select("line").distinct()
    chosen = written(lines.drop("halves").join(hopeful, "line"), "lines-chosen")
    texts = written(_texts(own, chosen), "lines-texts")
    keys = _variants(texts)
    minus = F.min(F.when(F.col("kind") < 2, F.col("line")))
    met = keys.groupBy("key").agg(minus.alias("minus"), F.min(F.when(F.col("kind") == 2, F.col("line"))).alias("whole"), F.count(F.lit(1)).alias("lines")).where("lines > 1")
    partner = F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("minus"))
    pairs = keys.join(met, "key").select("line", partner.alias("partner")).where("partner < line").groupBy("line").agg(F.min("partner").alias("partner"))
    near = written(_verified(pairs, texts), "lines-near")

    kept = lines.drop("halves").join(near, "line", "left_anti").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list("line_no").alias("_kept"))
    return _rebuilt(docs, kept, min_words)


def _rebuilt(docs: DataFrame, kept: DataFrame, min_words: int) -> DataFrame:
    columns = docs.columns
    lines = "kept_lines"
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("n_lines", T.LongType()), T.StructField("dropped_lines", T.ArrayType(T.LongType()))])
    text_at = columns.index("text")

    def rebuild(batches):
        for b in sliced(batches, text_at):
            texts, gone, counts = [], [], []
            for t, keep in zip(b.column(text_at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True):
                split = t.split("\n") if t is not None else []
                held = set(keep or ())
                stays = [i in held or n < min_words for i, n in enumerate(map(_n_words, split))]
                texts.append("\n".join(x for x, s in zip(split, stays, strict=True) if s) if t is not None else None)
                gone.append([i for i, s in enumerate(stays) if not s])
                counts.append(len(split))
            cols = [pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(len(columns))]
            yield pa.record_batch([*cols, pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int64()))], names=schema.names)

    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    rows = docs.join(kept, same, "left").select(*columns, F.col("_kept").alias(lines))
    return rows.mapInArrow(rebuild, schema)


def _n_words(line: str) -> int:
    return len(line.encode("utf-8", "surrogatepass").split())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_lines, n_dropped, dropped_lines (numbers from 0, separated by commas) and text_md5 (of
    what stays)."""
    out = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size("dropped_lines").cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


#: The same with the variants as texts, for DuckDB on small tables.
OP7_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM split),
worded AS (
  SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lines),
known AS (
  SELECT w, len(w) AS n, array_to_string(w, ' ') AS whole, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS first FROM worded WHERE len(w) >= 5 GROUP BY w),
numbered AS (SELECT *, row_number() OVER (ORDER BY first) AS id FROM known),
places AS (SELECT id, n, w, unnest(range(1, n + 1)) AS i FROM numbered WHERE n >= 10),
variants AS (SELECT id, n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS short FROM places),
near AS (
  SELECT id FROM variants QUALIFY id > min(id) OVER (PARTITION BY n, i, short)
  UNION SELECT greatest(v.id, k.id) FROM variants v JOIN numbered k ON k.whole = v.short AND k.n >= 10),
kept AS (SELECT first.doc_id AS doc_id, first.line_no AS line_no FROM numbered WHERE id NOT IN (SELECT id FROM near)),
marked AS (
  SELECT w.doc_id, w.line, w.line_no, len(w.w) < 5 OR k.doc_id IS NOT NULL AS stays FROM worded w LEFT JOIN kept k ON k.doc_id = w.doc_id AND k.line_no = w.line_no),
done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, coalesce(string_agg(line_no, ',' ORDER BY line_no) FILTER (NOT stays), '') AS dropped_lines,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '') AS text FROM marked GROUP BY ALL)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped_lines, '') AS dropped_lines, md5(coalesce(e.text, '')) AS text_md5
FROM documents d LEFT JOIN done e USING (doc_id)
"""

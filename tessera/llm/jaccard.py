"""N-gram Jaccard join by adaptive multi-match prefixes, down to the connected components of the links.

Two documents link when their sets of k-word shingles have a Jaccard similarity of `share` per cent or more. Every step
is exact, hashing aside (64 bits a shingle, 128 a set): nothing is capped, sampled or left out.

1. Documents with the same set form one class; what follows is about classes.
2. In any order of the shingles, a class of n of which a partner must hold `least` shares m shingles with that partner
   within the first n - least + m. In the order of hash values such prefixes cost nothing to find: a class stays only
   if enough of its prefix's shingles occur in other prefixes too (m: a tenth of its shingles).
3. For the classes that stay, all shingles are counted, and prefixes are taken in the order from rare to frequent.
4. In each prefix shingle's bucket the member with the shingle earliest stands for the bucket. Each class is compared
   with the one that stands for most of its shingles; the links give first components. This takes large groups of
   near copies together at a cost in proportion to their size.
5. What is left are pairs in different components. The cost of a class is estimated as the number of members of other
   components in its buckets, at places where classes of the same size can meet; its prefix is lengthened by one shingle
   each time that cost doubles, and a pair must then share as many shingles as the shorter of both lengthenings asks
   for, within the bounds that both sizes together set, before its sets are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, sliced, written
from .components import components
from .shingles import shingle_set, word_hashes

#: A class's shingles that it shares with a partner in the prefixes by hash value: one in so many.
HASH_MATCHES = 10
#: A prefix grows by a shingle at this cost, and with every doubling from there, by so many at most.
LENGTHEN_AT, LONGEST = 64.0, 16
#: Members of a bucket above which it is compared in blocks of about so many, each pair of blocks in a group of its own.
BLOCK_ROWS = 512
#: Classes, in rows of some 60 bytes, that may be broadcast; more are joined by shuffling.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """k words a shingle, and the least similarity in per cent."""

    k: int
    share: int

    def least(self, n):
        """Shingles of a class of n that every partner has."""
        return (self.share * n + 99) // 100

    def matches(self, n):
        """How many of them must be within the prefix by hash value."""
        return (n + HASH_MATCHES - 1) // HASH_MATCHES

    def alone(self, n):
        """Too few shingles for a similar set other than the same."""
        return n * 100 // self.share <= n

    def prefix(self, n):
        return n - self.least(n) + self.matches(self.least(n))


def _sets(docs: DataFrame, rule: Rule, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, carried columns, fp (of the set; null if empty), n and, of sets that may have partners, the prefix by hash
    value."""
    schema = T.StructType([docs.schema["doc_id"], *(docs.schema[c] for c in carried), T.StructField("fp", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def sets(batches):
        for b in sliced(batches, 1):
            fps, ns, heads = [], [], []
            for w in word_hashes(b.column(1).to_pylist()):
                s = shingle_set(w, rule.k)
                n = len(s)
                fps.append(_print(s) if n else None)
                ns.append(n)
                # a partner may be smaller by as much as the rule allows, so its prefix asks for no more than this
                heads.append(s[: 0 if rule.alone(n) else n - rule.least(n) + min(rule.matches(n), rule.least(n))])
            at = np.r_[0, np.cumsum([len(x) for x in heads])].astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            yield pa.record_batch([b.column(0), *b.columns[2:], pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=schema.names)

    return docs.select("doc_id", "text", *carried).mapInArrow(sets, schema)


def _print(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _tokens(docs: DataFrame, chosen: DataFrame, rule: Rule) -> DataFrame:
    """The whole sets of the chosen classes (cls, fp, of their document rep): cls, n, tokens."""
    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def sets(batches):
        for b in sliced(batches, 2):
            rows = []
            for c, fp, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_hashes(b.column(2).to_pylist()), strict=True):
                s = shingle_set(w, rule.k)
                if len(s) and _print(s) == fp:  # else another text of the same doc_id
                    rows.append((c, s))
            at = np.r_[0, np.cumsum([len(s) for _, s in rows])].astype(np.int32)
            flat = np.concatenate([s for _, s in rows]) if rows else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array([c for c, _ in rows], pa.int64()), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=schema.names)

    few = chosen.count() <= BROADCAST_ROWS
    side = F.broadcast(chosen) if few else chosen
    rows = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("rep")))
    return rows.select("cls", "fp", "text").mapInArrow(sets, schema).dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def verify(batches):
        for b in batches:
            (left, right), ok = (b.column(i) for i in (2, 3)), []
            for i in range(b.num_rows):
                x, y = (np.asarray(c[i].values) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= rule.share * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=schema.names)

    one, two = (sets.select(F.col("cls").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(verify, schema)


def _near(rule: Rule, na: Column, nb: Column, pa: Column, pb: Column, extra: Column) -> Column:
    """Whether a shingle at places pa and pb of classes of na and nb can be among the first `extra` that they share."""
    least = F.floor((F.lit(rule.share) * (na + nb) + F.lit(99 + rule.share)) / F.lit(100 + rule.share))
    similar = F.least(na, nb) * 100 >= F.greatest(na, nb) * rule.share
    return similar & (pa < na - least + extra) & (pb < nb - least + extra)


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join of buckets with themselves, and its keys: each two members of a bucket meet once either way."""
    one, two = (rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", "comp", "extra")]) for s in "ab")
    large = written(rows.groupBy("token").count().where(F.col("count") > BLOCK_ROWS).select("token", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks")), "jaccard-large")
    if large.isEmpty():
        return one, two, ["token"]

    def dealt(side: DataFrame, cls: str, own: str, other: str) -> DataFrame:
        blocks = F.coalesce("blocks", F.lit(1))
        mine = F.pmod(F.xxhash64(cls), blocks).alias(own)
        return side.join(large, "token", "left").select(*side.columns, mine, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias(other))

    return dealt(one, "cls_a", "block_a", "block_b"), dealt(two, "cls_b", "block_b", "block_a"), ["token", "block_a", "block_b"]


def near_duplicates(docs: DataFrame, *, k: int = 5, share: int = 80, carried: Sequence[str] = (), component_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id and the carried columns of every row of `docs` (doc_id, text).

    component_id: the smallest doc_id that links reach; of documents without words or text their own, since they link
    with nothing. A text of fewer than k words has the whole sequence as its only shingle. Rows that share a doc_id are
    rows of their own; null doc_ids are linked like others and never the smallest unless all of a component are null.
    An empty table gives no rows. Other columns of `docs` don't matter. component_col: a column that tells components
    apart even where they share their smallest doc_id; null for texts without words.
    """
    rule = Rule(k, share)
    rows = written(_sets(docs, rule, carried), "jaccard-sets")
    classes = written(
        rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix")).withColumn("cls", F.monotonically_increasing_id()),
        "jaccard-classes",
    )

    # classes with enough shingles that occur in other prefixes
    heads = classes.select("cls", F.explode("prefix").alias("token"))
    common = heads.groupBy("token").count().where("count > 1").select("token")
    hits = heads.join(common, "token").groupBy("cls").count()
    least = F.floor((F.lit(rule.share) * F.col("n") + 99) / 100)
    need = F.floor((least + (HASH_MATCHES - 1)) / HASH_MATCHES)
    chosen = written(hits.join(classes.select("cls", "n", "fp", "rep"), "cls").where(F.col("count") >= F.least(need, least)).select("cls", "fp", "rep"), "jaccard-chosen")

    # their prefixes from rare to frequent; shingles that no other class has need no bucket
    sets = written(_tokens(docs, chosen, rule), "jaccard-tokens")
    spread = sets.select("cls", "n", F.explode("tokens").alias("token"))
    counts = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("cls")
    ranked = spread.join(counts, "token").withColumn("pos", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "token")) - 1)
    first = F.col("n") - F.floor((F.lit(rule.share) * F.col("n") + 99) / 100) + 1
    buckets = written(ranked.where(F.col("pos") < first + (LONGEST - 1)).select("token", "cls", "n", "pos", (F.col("pos") < first).alias("base")), "jaccard-buckets")

    # a star in each bucket
    base = buckets.where("base")
    stands = base.groupBy("token").agg(F.min(F.struct("pos", "cls", "n")).alias("s"))
    star = base.join(stands, "token").where((F.col("cls") != F.col("s.cls")) & _near(rule, F.col("n"), F.col("s.n"), F.col("pos"), F.col("s.pos"), F.lit(1)))
    shared = star.groupBy(F.col("cls").alias("a"), F.col("s.cls").alias("b")).count()
    best = shared.groupBy("a").agg(F.max(F.struct("count", (-F.col("b")).alias("b"))).alias("s")).select("a", (-F.col("s.b")).alias("b"))
    first_links = written(_verified(best, sets, rule), "jaccard-links")
    labels = components(first_links)

    # the pairs between components
    placed = buckets.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    placed = written(placed, "jaccard-placed")
    # two classes of the same size can only meet at places before this one; it tells what a prefix will cost
    early = F.col("pos") < F.col("n") - F.floor((2 * rule.share * F.col("n") + F.lit(99 + rule.share)) / F.lit(100 + rule.share)) + 1
    members = placed.where("base").withColumn("early", early.cast("int")).groupBy("token", "comp").agg(F.count(F.lit(1)).alias("mine"), F.sum("early").alias("mine_early"))
    everyone = members.groupBy("token").agg(F.sum("mine").alias("all"), F.sum("mine_early").alias("all_early"))
    met = placed.where("base").join(members, ["token", "comp"]).join(everyone.where("all > 1"), "token")
    others = met.groupBy("cls").agg(F.sum(F.col("all") - F.col("mine")).alias("reach"), F.sum(F.when(early, F.col("all_early") - F.col("mine_early")).otherwise(0)).alias("cost")).where("reach > 0")
    extra = F.least(F.lit(1) + F.floor(F.log2(F.greatest(F.lit(1.0), 2 * F.col("cost") / F.lit(LENGTHEN_AT)))), F.lit(LONGEST), least)
    priced = placed.join(others, "cls").withColumn("extra", extra).where(F.col("pos") < first + F.col("extra") - 1)
    priced = written(priced.select("token", "cls", "n", "pos", "comp", "extra"), "jaccard-priced")
    one, two, keys = _blocks(priced)
    asked = F.least("extra_a", "extra_b")
    met = (F.col("comp_a") < F.col("comp_b")) & _near(rule, *(F.col(f"{c}_{s}") for c in ("n", "pos") for s in "ab"), asked)
    pairs = one.join(two, keys).where(met).groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(asked).alias("asked")).where("shared >= asked")
    last_links = written(_verified(pairs, sets, rule), "jaccard-links")

    links = first_links.union(last_links)
    if not last_links.isEmpty():
        labels = components(links)
    named = classes.select("cls", "fp", "rep").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = named.join(smallest, "comp").select("fp", "component_id", "comp")
    full = rows.where("n > 0").join(ids, "fp")
    more = [*carried, *([F.col("comp").alias(component_col)] if component_col else [])]
    full = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
    none = rows.where("n = 0").withColumn("comp", F.lit(None).cast("long"))
    return full.unionByName(none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more))


def op2_jaccard_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by shingles of three words and a similarity of 0.9: doc_id, n_shingles, component_id."""
    return near_duplicates(documents(spark, sf_dir), k=3, share=90)


#: The same by counting the shingles that each two documents share, for DuckDB on small tables.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT x, y FROM pairs WHERE 100 * shared >= 90 * (m + n - shared)),
links AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sets s
"""

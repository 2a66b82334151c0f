"""A training-data pipeline over `documents`: each stage reads what the one before it has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe, jaccard, lines, mixing, toxicity
from tessera.llm.common import documents, fresh, put_back, set_aside, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the folder's labelled documents, scores below 0.5. A null text is scored as an
    empty one; equal texts go or stay together; repeated rows stay."""
    score = fresh(docs, "toxicity")
    return toxicity.scored(docs, toxicity.fitted(spark, sf_dir), out_col=score).where(F.col(score) < 0.5).drop(score)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier documents, or earlier lines, have. Those that lose all they had go."""
    aside, names = set_aside(docs, ["doc_id", "text"])
    out = lines.deduplicated(aside)
    emptied = (F.size("dropped_lines") > 0) & (F.length(F.trim(F.regexp_replace("text", r"[\t-\r]", " "))) == 0)
    kept = put_back(out.where(F.col("text").isNull() | ~emptied), names)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row: that of the smallest doc_id, null last, and of its texts the
    one of the smallest hash. Rows without words stay."""
    # rows that share a doc_id are told apart by their texts
    text_hash = fresh(docs, "text_hash")
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    ids = written(jaccard.near_duplicates(hashed, carried=[text_hash], component_col="component"), "pipeline-near").where("component is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", text_hash)
    first = ids.groupBy("component").agg(F.min(place).alias("first"))
    id_gone, hash_gone = (fresh(hashed, x) for x in ("id_gone", "hash_gone"))
    gone = ids.join(first, "component").where(place != F.col("first")).select(F.col("doc_id").alias(id_gone), F.col(text_hash).alias(hash_gone)).distinct()
    kept = hashed.join(gone, F.col("doc_id").eqNullSafe(F.col(id_gone)) & (F.col(text_hash) == F.col(hash_gone)), "left_anti").select(docs.columns)
    if ids.groupBy("doc_id", text_hash).count().where("count > 1").isEmpty():
        return kept
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # of rows that agree in both the smallest by their other columns, in the order of the columns
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = fresh(docs, "row")
    ordered = F.struct(F.lit(0), *[c for c in others if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))])
    one = kept.where(worded).groupBy("doc_id", "text").agg(F.min_by(F.struct(F.lit(0), *others), ordered).alias(row))
    return one.select(*[F.col(c) if c in ("doc_id", "text") else F.col(row)[c].alias(c) for c in docs.columns]).unionByName(kept.where(~worded))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, as often as it takes them. Null and empty texts have no words and aren't
    taken; null sources are one source; ties go by a hash of doc_id and text, so that reruns agree."""
    sizes = written(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"), mixing.shuffle_key(F.col("doc_id"), F.col("text")).alias("key")), "pipeline-sizes")
    # of rows that are equal in all of these any may be taken, so the largest number of copies stands for them
    own_id, own_key, own_source, times, copy = (fresh(docs, x) for x in ("own_id", "own_key", "own_source", "times", "copy"))
    copies = mixing.mix(sizes, size_col="words", order_col="key").where("copies > 0").groupBy(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("source").alias(own_source)).agg(F.max("copies").alias(times))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (mixing.shuffle_key(F.col("doc_id"), F.col("text")) == F.col(own_key))
    taken = docs.join(copies, same)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: doc_id, token_ids (little-endian, four bytes each), n_tokens, ids_sha256 and decoded_sha256 of
    each of its documents. A null text has no tokens; rows stay as they are, repeated ones too."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("byte-level BPE", encoded),
]
#: The stages on toxicity, near lines and similarity can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents, each written and read again. An empty table goes through as one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

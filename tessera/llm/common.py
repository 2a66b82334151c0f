"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the order that `shuffle_key` deals.
KEY_BITS = 60

_own_dir: dict[str, str] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: `spark.checkpoint.dir`; only where that is unset (tests) an own folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dir[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors, and
    gives Spark the real size, so that it broadcasts the table only if it is below the threshold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing needs any more."""
    for t in tables:
        spark = t.sparkSession
        for f in {x.rpartition("/")[0] for x in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(rows: DataFrame, own: Sequence[str] = (), replaced: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """`rows` with every column but `own` under a name that no helper column of an operator has, and these names by the old
    ones, in order; columns that the operator replaces are left out. So extra columns of any name can be carried along."""
    own_names, gone = {c.lower() for c in own}, {c.lower() for c in replaced}
    taken = {c.lower() for c in rows.columns}
    names: dict[str, str] = {}
    for i, c in enumerate(rows.columns):
        if c.lower() in own_names:
            names[c] = c
        elif c.lower() not in gone:
            new = f"carried{i}"
            while new in taken:
                new += "_"
            names[c] = new
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def put_back(rows: DataFrame, names: dict[str, str], *others: str) -> DataFrame:
    """The columns under their old names, in their old order, then others."""
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()], *others)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(*columns: Column) -> Column:
    """A number below 2**KEY_BITS from the columns' values (null unlike empty): the same on every run."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, KEY_BITS // 4), 16, 10).cast("long")


def slice_of(key: Column, slices: Column) -> Column:
    """The slice, of so many equal ones, that a `shuffle_key` falls into; in the order of the keys."""
    return F.shiftright(F.shiftright(key, KEY_BITS - 30) * slices, 30)


def crc32_of(value: Column) -> Column:
    """Unsigned CRC-32 of a column's text in UTF-8; null as no bytes."""
    return F.crc32(F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8"))


def sliced(batches: Iterable[pa.RecordBatch], at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of the column `at`, one row at least: what is made of a slice is
    handed on before the next one is looked at."""
    for b in batches:
        n = np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0), np.int64)
        part = (np.cumsum(n) - n) // size
        cuts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), b.num_rows] if len(n) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(i, j - i)
        release()


def release() -> None:
    """Gives free memory back to the system: Python workers wait for later tasks with what they hold."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)

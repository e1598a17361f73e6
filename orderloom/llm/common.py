"""What the text operators share: the folder for intermediate tables, and small column helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the contracts name, U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orderloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver's JVM ends."""
    root = f"{shared_dir(spark).rstrip('/')}/orderloom/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return root


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The operator whose task ran last in this Python worker, and what drops the things it keeps there.
_LAST: dict[str, Callable[[], None] | None] = {}


def turn(operator: str, drop: Callable[[], None] | None = None) -> None:
    """First call of a task in a Python worker: if another operator ran there before, its tables and caches go back to the system."""
    if operator in _LAST:
        return
    for last in _LAST.values():
        if last is not None:
            last()
    if _LAST:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    _LAST.clear()
    _LAST[operator] = drop


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Hint a broadcast only when the counted rows stay within a bound; beyond it the planner shuffles."""
    return F.broadcast(df) if rows <= bound else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Runs of characters other than the fixed white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def input_partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def join_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; the right side's keys go."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, on, how).drop(*(f"_right_{k}" for k in keys))

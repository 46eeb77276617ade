"""What the corpus operators share: the cluster's shared folder, tables written there to cut lineage, joins with hot keys."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"
#: A key is hot if it has over one in so many rows: there can't be more hot keys than that, so they may go to every task.
HOT_SHARE = 1_000
#: Shares of the tasks that sums of fixed size are made over first.
FAN = 256
#: Whether the shuffle files of a job go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Open(threading.local):
    """Tables written inside each open ``scratch`` block of this thread, innermost last."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_open = _Open()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Where it is unset a local one, on one machine
    only: a cluster without the setting is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    warnings.warn("spark.checkpoint.dir is unset; tables go to a local folder", stacklevel=2)
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cuewright/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later stages survive lost executors. The shuffle files of
    the write go with its end, since only the table is read from then on.

    Inside a ``scratch`` block the table goes when the block ends; with ``keep`` it lasts as long as the block around that one."""
    spark = df.sparkSession
    path = new_path(spark, name)
    note(path, keep)
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_dealt(df: DataFrame, name: str, key: str, parts: int, keep: bool = False) -> DataFrame:
    """As ``materialise``, in ``parts`` buckets by the hash of ``key``: joined by ``key`` to rows that ``repartition`` deals to as many
    partitions, the table stays where it is. Its name in the catalogue goes at once, the files as those of ``materialise``."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"dealt_{uuid.uuid4().hex}"
    note(path, keep)
    with _cleaned(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


@contextmanager
def _cleaned(spark: SparkSession):
    """Shuffle files of the jobs in this block go with their end."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def note(path: str, keep: bool = False) -> None:
    """Have ``path`` removed when the block ends, or with ``keep`` the one around it."""
    if len(_open.blocks) > keep:
        _open.blocks[-1 - keep].append(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def files_of(spark: SparkSession, path: str) -> int:
    """Number of Parquet files in the folder ``path``."""
    files, place = _place(spark, path)
    return sum(f.getPath().getName().endswith(".parquet") for f in files.listStatus(place))


def tidy(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that no live plan needs now, not when the driver's memory happens to fill up. Python's plans go
    first: they hold the others."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialise`` writes in this block, but for those it is told to keep, are removed at its end. Nothing lazy that
    reads them may leave the block."""
    _open.blocks.append([])
    try:
        yield
    finally:
        for path in _open.blocks.pop():
            remove(spark, path)
        tidy(spark)


@contextmanager
def noted():
    """A list of the tables that are left when the block ends, for the caller to remove."""
    _open.blocks.append([])
    paths: list[str] = []
    try:
        yield paths
    finally:
        paths += _open.blocks.pop()


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the identifier's text modulo ``modulus``: the fold of a row; null identifiers fall in fold null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sum_in_levels(parts: DataFrame, add) -> DataFrame:
    """``parts`` (block, ...), some rows a task, summed by ``add`` (a pandas frame of one block to one of a row, like ``parts``): first over ``FAN``
    shares of the tasks, then over these, so no group holds a row of every task."""
    shares = parts.withColumn("share", F.spark_partition_id() % FAN)
    return shares.groupBy("block", "share").applyInPandas(lambda pdf: add(pdf.drop(columns="share")), parts.schema).groupBy("block").applyInPandas(add, parts.schema)


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to the one row of ``keyed`` with their ``key``, where ``count`` says how many of ``total`` rows have it.

    Rows of hot keys stay where they are: the hot keys, ``HOT_SHARE`` at most, go to every task. Only the others are shuffled."""
    hot = F.col(count) * HOT_SHARE > total
    known = F.broadcast(keyed.where(hot).drop(count))
    rest = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot).drop(count), key)
    return rows.join(known, key).unionByName(rest)

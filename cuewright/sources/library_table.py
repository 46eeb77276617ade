"""A library as Parquet files by hash bucket of the path, upserted in place (inventory K1-K5, J10): a batch touches the buckets of its own
new rows alone, the files of all others stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.sources.tables import Tables

#: Columns of a library table (K1, K6).
LIBRARY = "id long, filepath string, duration_secs double, fingerprint_raw binary, n_hashes int, title string, artist string, album string, indexed_at string"
#: Buckets of a new library; a bucket should stay some hundred MB.
BUCKETS = 64


def as_library(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows with a library table's columns and types (K1, K6); columns that they lack are null. ``more`` follow."""
    fields = [f.strip().split(" ") for f in LIBRARY.split(",")]
    return rows.select(*[(F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields], *more)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """The library's rows; ``bucket`` prunes files."""
    return spark.read.schema(f"{LIBRARY}, bucket int").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and len(files.listStatus(place)) > 0


def upsert_library(rows: DataFrame, path: str, rebuild: bool = False, replace: bool = False, limit: int | None = None, order: str = "id", buckets: int = BUCKETS) -> tuple[int, int]:
    """Add ``rows`` to the library at ``path``; (rows taken, tracks there are then).

    Rows without path go. A path that the library has keeps its row (K3), or with ``replace`` takes the new one. Of a path's new rows the
    last by ``order`` stays (K4); ``limit`` takes the first so many new rows, repeats counted. ``rebuild`` starts anew. New paths are
    appended to their buckets; replaced ones rewrite theirs. A run that fails before Spark's commit leaves the library as it was. A library keeps
    the number of buckets that it was begun with.
    """
    spark = rows.sparkSession
    tables = Tables(spark, "upsert")
    bucket = F.pmod(F.xxhash64("filepath"), F.lit(buckets)).cast("int")
    own = [c.split(" ")[0] for c in LIBRARY.split(", ")]
    batch = as_library(rows, F.col(order).alias("ord")).where("filepath is not null and trim(filepath) <> ''").withColumn("bucket", bucket)
    old = None if rebuild or not _exists(spark, path) else read_library(spark, path)
    fresh = batch
    if old is not None and not replace:
        batch = tables.write(batch, "batch")
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # as many as there are buckets
        fresh = batch.join(old.where(F.col("bucket").isin(touched)).select("bucket", "filepath"), ["bucket", "filepath"], "left_anti")
    if limit is not None:
        fresh = fresh.orderBy("ord").limit(limit)
    fresh = tables.write(fresh, "fresh")
    last = F.row_number().over(Window.partitionBy("filepath").orderBy(F.desc("ord")))
    kept = fresh.withColumn("n", last).where("n = 1").select(*own, "bucket")
    taken = fresh.count()
    if old is None:
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    elif taken and not replace:
        kept.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    elif taken:
        touched = [r[0] for r in kept.select("bucket").distinct().collect()]
        stay = old.where(F.col("bucket").isin(touched)).join(kept.select("bucket", "filepath"), ["bucket", "filepath"], "left_anti").select(*own, "bucket")
        merged = tables.write(stay.unionByName(kept), "merged")  # what is read can't be overwritten at once
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    tables.drop()
    return taken, read_library(spark, path).count()

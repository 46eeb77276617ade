"""Results as texts (inventory B1-B5, B7, A26): JSON, extended M3U and plain lists, one row per recording, and their files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.text import clock
from cuewright.sources.tables import Tables


def _joined(rows: DataFrame, key: str, line: Column, *order: Column) -> DataFrame:
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")))).alias("x"))
    return grouped.select(key, F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("text"))


def text_list(tracks: DataFrame, unknowns: DataFrame, key: str) -> DataFrame:
    """``clock  artist - title (score)`` lines by start, unknowns after tracks that start with them."""
    line = F.concat("artist", F.lit(" - "), "title", F.format_string(" (%.2f)", F.round("score", 2)))
    rows = tracks.select(key, "start_sec", F.lit(0).alias("kind"), "ord", line.alias("body")).unionByName(unknowns.select(key, "start_sec", F.lit(1).alias("kind"), "ord", F.lit("[unidentified]").alias("body")))
    return _joined(rows, key, F.concat(clock("start_sec"), F.lit("  "), "body"), F.col("start_sec"), F.col("kind"), F.col("ord"))


def playlist(tracks: DataFrame, key: str) -> DataFrame:
    """Extended M3U (B2): whole seconds, at least 1; the path or an empty line."""
    seconds = F.greatest(F.lit(1), F.bround(F.col("end_sec") - F.col("start_sec")).cast("int"))
    name = F.when(F.col("artist") == "", F.col("title")).otherwise(F.concat("artist", F.lit(" - "), "title"))
    rows = _joined(tracks, key, F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), name, F.lit("\n"), F.coalesce("filepath", F.lit(""))), F.col("start_sec"), F.col("ord"))
    return rows.select(key, F.concat(F.lit("#EXTM3U\n"), "text").alias("text"))


def json_result(tracks: DataFrame, unknowns: DataFrame, key: str) -> DataFrame:
    """A JSON object per recording (B1, B10): times to 2 places, scores to 3, unknown stretches apart."""
    t = F.struct("start_sec", "ord", F.round("end_sec", 2).alias("end_sec"), "artist", "title", F.round("score", 3).alias("score"), "source", F.col("n_merged").alias("n_segments_merged"))
    u = F.struct("start_sec", "ord", F.round("end_sec", 2).alias("end_sec"))
    both = tracks.groupBy(key).agg(F.array_sort(F.collect_list(t)).alias("t")).join(unknowns.groupBy(key).agg(F.array_sort(F.collect_list(u)).alias("u")), key, "full")
    out_t = F.transform("t", lambda x: x.withField("start_sec", F.round(x["start_sec"], 2)).dropFields("ord"))
    out_u = F.transform("u", lambda x: x.withField("start_sec", F.round(x["start_sec"], 2)).dropFields("ord"))
    return both.select(key, F.to_json(F.struct(F.col(key).cast("string").alias("source_input"), F.coalesce(out_t, F.array()).alias("tracks"), F.coalesce(out_u, F.array()).alias("unknown_segments"))).alias("json"))


#: Columns of a result file.
RESULT = "source_input string, tracks array<struct<start_sec:double,end_sec:double,artist:string,title:string,score:double,source:string,n_segments_merged:long>>, unknown_segments array<struct<start_sec:double,end_sec:double>>"


def write_results(tracks: DataFrame, unknowns: DataFrame, key: str, path: str) -> None:
    """The three forms (B5) as text files below ``path``: a line a recording of JSON, compressed by gzip, else blocks between blank lines. ``tracks`` have
    a ``filepath``.

    All are written beside ``path`` and published together by one rename, so a run that fails leaves nothing there. An older result is
    replaced; until the rename it stays whole. Both frames are evaluated once, whatever the number of forms.
    """
    spark = tracks.sparkSession
    tables = Tables(spark, "result-rows")
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        tracks, unknowns = tables.write(tracks, "tracks"), tables.write(unknowns, "unknowns")
        json_result(tracks, unknowns, key).select("json").write.option("compression", "gzip").text(f"{draft}/json")
        for name, rows in (("m3u", playlist(tracks, key)), ("txt", text_list(tracks, unknowns, key))):
            rows.select("text").write.option("lineSep", "\n\n").text(f"{draft}/{name}")
        if files.exists(place(path)):
            files.delete(place(path), True)
        if not files.rename(place(draft), place(path)):
            raise OSError(f"{draft} can't be renamed to {path}")
    finally:
        files.delete(place(draft), True)
        tables.drop()


def read_results(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tracks, unknowns) in result files (A26): source_input, ord and the fields. An object a line, or without ``lines`` one over the lines of
    each file. A damaged object is an error, not a null result."""
    rows = spark.read.schema(RESULT).option("mode", "FAILFAST").option("multiLine", not lines).json(path)
    t = rows.select("source_input", F.posexplode("tracks").alias("ord", "t")).select("source_input", "ord", "t.*").withColumnRenamed("n_segments_merged", "n_merged")
    u = rows.select("source_input", F.posexplode("unknown_segments").alias("ord", "u")).select("source_input", "ord", "u.*")
    return t, u


def write_merged(tracks: DataFrame, unknowns: DataFrame, key: str, path: str) -> None:
    """The merged result (B7) at a new path: what is being read can't be overwritten."""
    json_result(tracks, unknowns, key).select("json").write.text(path)

from datetime import datetime, timedelta

from cuewright import cli
from cuewright.operators import catalogue, matching
from cuewright.streaming import collapse
from pyspark.sql import functions as F


def test_sessions(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("m", t + timedelta(seconds=s), "A", "x", 0.5 + s / 1000) for s in (0, 60, 120, 400)] + [("m", t + timedelta(seconds=50), "B", "y", 0.1), ("m", t + timedelta(days=1), "Z", "z", 0.1)]
    schema = "mix_id string, ts timestamp, artist string, title string, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = collapse.sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "mix_id", "ts")
    query = stream.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.artist, r.n_merged) for r in spark.table("runs").collect()}
    assert got == {("A", 3), ("A", 1), ("B", 1)}


def test_latest_by_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, ts int, v string")
    assert {tuple(r) for r in collapse.latest_by_key(rows, "k", "ts").collect()} == {("a", 2, "y"), ("b", 1, None)}


def test_ttl_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1.0, "old"), ("a", 5.0, "new"), ("b", 0.0, "gone"), ("c", 3.0, "edge")], "k string, ts double, v string")
    assert {r.v for r in matching.ttl_cache(rows, "k", F.lit(10.0), 7.0).collect()} == {"new", "edge"}
    assert {r.v for r in matching.ttl_cache(rows, "k", F.lit(10.0), 7.0, most=1).collect()} == {"new"}
    library = spark.createDataFrame([("p", 1)], "path string, n int")
    batch = spark.createDataFrame([("p", 9), ("q", 2), ("q", 3)], "path string, n int")
    assert {tuple(r) for r in matching.library_upsert(library, batch, "path", "n").collect()} == {("p", 1), ("q", 3)}


def test_mirror_scores(spark):
    asks = spark.createDataFrame([("k", "Live Set 2024")], "k string, query string")
    found = spark.createDataFrame([("k", 0, "live set 2024", 200.0), ("k", 1, "LIVE set", 400.0), ("k", 2, "", None)], "k string, ord int, title string, duration_sec double")
    got = {r.ord: (round(r.score, 6), r["rank"]) for r in catalogue.ranked_mirrors(asks, found, "k").collect()}
    assert got == {0: (0.6, 2), 1: (round(2 / 3, 6), 1), 2: (0.0, 3)}


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 20), (2, 60)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert cli.main(["list"]) == 0 and "paged_scan" in capsys.readouterr().out
    assert cli.main(["run", "paged_scan", str(tmp_path), "--out", f"{tmp_path}/o"]) == 0
    assert sorted((r.p_partkey, r.page_no, r.page_size) for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [(1, 0, 20), (2, 0, 25), (2, 1, 25), (2, 2, 10)]

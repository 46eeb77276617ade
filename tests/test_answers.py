"""The data source of recorded answers: paging, limits, filters."""

import json

import pytest
from cuewright.sources import answers
from pyspark.sql import functions as F


def record(root, query, index, n, first=0):
    folder = root / f"query={query}" / f"index={index}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text(json.dumps({"data": [{"id": first + i, "title": f"t{first + i}", "artist": {"name": query}, "preview": "u"} for i in range(n)]}))


@pytest.fixture
def folder(tmp_path):
    record(tmp_path, "a", 0, 25)
    record(tmp_path, "a", 25, 25, 25)
    record(tmp_path, "a", 50, 25, 50)
    record(tmp_path, "b%3Ac", 0, 20)  # fewer than a page holds: the next is asked all the same
    record(tmp_path, "b%3Ac", 25, 3, 100)
    record(tmp_path, "d", 0, 25)
    record(tmp_path, "d", 25, 0)
    record(tmp_path, "d", 50, 25, 50)  # behind an empty page
    record(tmp_path, "e", 25, 5)
    return tmp_path


def read(spark, folder, **options):
    answers.register(spark)
    return spark.read.format(answers.FORMAT).options(path=str(folder), **options).load()


def test_pages_limits_and_empty_pages(spark, folder):
    got = {r["query"]: r["n"] for r in read(spark, folder, limit=60).groupBy("query").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 60, "b:c": 23, "d": 25}
    rows = read(spark, folder, limit=30).where("query = 'a'").orderBy("index", "pos").collect()
    assert [r["id"] for r in rows] == list(range(30)) and {r["index"] for r in rows} == {0, 25} and rows[0]["artist"] == "a"
    assert read(spark, folder, limit=22).where("query = 'b:c'").agg(F.max("id")).first()[0] == 101


def test_filters_leave_partitions_out(spark, folder):
    whole = read(spark, folder, limit=60)
    assert whole.rdd.getNumPartitions() == 4
    some = whole.where(F.col("query").isin("a", "b:c") & (F.col("id") > 20))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 39 + 3
    assert whole.where("query = 'zz'").count() == 0 and whole.where("query = 'b:c'").rdd.getNumPartitions() == 1


def test_damaged_answers_are_errors(spark, tmp_path):
    record(tmp_path, "a", 0, 3)
    (tmp_path / "query=a" / "index=0" / "part-1.txt").write_text('{"data": [')
    with pytest.raises(Exception, match="JSON|Expecting"):
        read(spark, tmp_path).collect()


def test_paced_stream_takes_each_answer_once(spark, tmp_path):
    answers.register(spark)
    root = tmp_path / "answers"
    for k in range(7):
        record(root, f"q{k}", 0, 2, 10 * k)
    stream = spark.readStream.format(answers.FORMAT).options(path=str(root), requests=3, progress=str(tmp_path / "plan")).load()

    def run():
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
            return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        finally:
            query.stop()

    assert run() == [6, 6, 2]
    assert run() == []
    for k in (7, 8, 9):
        record(root, f"q{k}", 0, 2, 10 * k)
    record(root, "qa", 0, 2, 100)
    assert run() == [6, 2]
    got = sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(10 * k + i for k in range(11) for i in range(2))

"""What must not grow with the input: rows of a task, evaluations of a frame, files of recorded answers."""

import json
import os

from cuewright.plans import library_queries, text_queries
from cuewright.sources import answers, render
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_more_entries_are_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(text_queries, "TASK_ROWS", 10**9)
    names = ("entries", "cascade", "tier2_merge")
    want = {name: sorted(map(tuple, getattr(text_queries, name)(spark, SF).collect())) for name in names}
    monkeypatch.setattr(text_queries, "TASK_ROWS", 500)
    got = {name: getattr(text_queries, name)(spark, SF) for name in names}
    assert {name: sorted(map(tuple, df.collect())) for name, df in got.items()} == want
    sizes = [r["count"] for r in got["entries"].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 1000


def test_results_are_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    track = "mix string, ord int, start_sec double, end_sec double, artist string, title string, score double, source string, n_merged long, filepath string"
    rows = spark.createDataFrame([("m", k, 60.0 * k, 60.0, "A", "x", 0.9, "library", 1, "/m") for k in range(4)], track).mapInArrow(run, track)
    render.write_results(rows, spark.createDataFrame([("m", 9, 60.0, 90.0)], "mix string, ord int, start_sec double, end_sec double"), "mix", f"{tmp_path}/out")
    assert seen.value == 4 and sorted(os.listdir(tmp_path / "out")) == ["json", "m3u", "txt"]


def test_pages_in_blocks(spark, tmp_path):
    page = lambda index, n: json.dumps({"index": index, "data": [{"id": index + k} for k in range(n)]})
    last = answers.PAGE * answers.BLOCK
    for query, block, lines in (("a", 0, [page(i, 25) for i in range(25, last, 25)] + [page(0, 25)]), ("a", 1, [page(last, 3)]), ("b", 0, [page(0, 2), page(50, 1)])):
        folder = tmp_path / f"query={query}" / f"block={block}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text("\n".join(lines) + "\n")
    answers.register(spark)
    got = spark.read.format(answers.FORMAT).option("path", str(tmp_path)).option("limit", 10**6).load().select("query", "id").collect()
    assert sorted(map(tuple, got)) == [("a", k) for k in range(last + 3)] + [("b", 0), ("b", 1)]


def test_recorded_pages_are_few_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(library_queries.Tables, "write", None)
    spark.read.parquet("/root/testdata/sf0.01/part.parquet").crossJoin(spark.range(5)).withColumn("p_partkey", F.col("p_partkey") * 5 + F.col("id")).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    made = []
    monkeypatch.setattr(library_queries, "Tables", lambda *_: type("T", (), {"folder": made.append(1) or f"{tmp_path}/answers"}))
    library_queries.recorded_pages(spark, str(tmp_path))
    files = [f for _, _, fs in os.walk(f"{tmp_path}/answers") for f in fs if f.startswith("part-")]
    assert made and 0 < len(files) <= 50

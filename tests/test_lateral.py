"""The table function in SQL gives what the DataFrame forms give."""

import json

import pytest
from cuewright.functions import extract, lateral

TEXTS = [
    None, "", "Tracklist", "0:00 A - B\n1:02:03 - C – D\r\n [12:34] (E | F)\n5. 07:08 no artist\n09:99 x - \n1:2 bad - y\nnot a line\x0b3:00 \xa0G — [H] ",
    "tracklist\n1) A - B\n- C - D\n* E – F\n4. G | H\n• I - J\n0:10 K - L", "songs played\n1) A - B\n2) C - D", "1) A - B\n2) C - D\n3) E - F\n4) G - H\n5) I - J", "0:00\n00:00 -\n1:00:00 a - b - c\n  2:00)  x",
]
CHAPTERS = [None, "x", "[]", "{}", json.dumps({"chapters": [{"start_time": 0, "title": "Intro"}, {"start_time": 5.5, "title": "01. A - B"}, {"title": "no time"}, {"start_time": 9, "title": " (C – D) "}, {"start_time": 10, "title": "2) solo"}, {"start_time": 11, "title": "  "}]})]


@pytest.mark.parametrize(("kind", "texts"), [("timed", TEXTS), ("untimed", TEXTS), ("chapters", CHAPTERS)])
def test_equal_to_the_dataframe_forms(spark, kind, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lateral.register(spark)
    form = {"timed": extract.timed_lines, "untimed": extract.untimed_lines, "chapters": extract.chapters}[kind]
    want = form(docs, "text", "id", "s").drop("source").withColumnRenamed("ord", "pos")
    got = spark.sql(f"SELECT d.id, e.* FROM {{docs}} d, LATERAL list_entries(d.text, '{kind}') e", docs=docs)
    columns = ["id", "pos", *([] if kind == "untimed" else ["start_sec"]), "artist", "title"]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(columns).collect())) and got.count() >= 3


def test_schema_depends_on_the_kind(spark):
    lateral.register(spark)
    assert spark.sql("SELECT * FROM list_entries('0:10 a - b', 'timed')").dtypes == [("pos", "int"), ("start_sec", "double"), ("artist", "string"), ("title", "string")]
    assert spark.sql("SELECT * FROM list_entries('0:10 a - b', 'untimed')").columns == ["pos", "artist", "title"]
    with pytest.raises(Exception, match="kind of list"):
        spark.sql("SELECT * FROM list_entries('x', 'other')")

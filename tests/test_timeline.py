import random

import pytest
from cuewright.operators import folds, timeline
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "mix_id string, ord int, start_sec double, end_sec double, artist string, title string, score double, source string"


def rows(spark, *items):
    return spark.createDataFrame([("m", i, float(s), float(e), a, t, sc, "acoustid") for i, (s, e, a, t, sc) in enumerate(items)], SCHEMA).repartition(3)


def unknowns(spark, *items):
    return spark.createDataFrame([("m", i, float(s), float(e)) for i, (s, e) in enumerate(items)], "mix_id string, ord int, start_sec double, end_sec double")


def test_collapse(spark):
    b, a = ("Burna Boy", "Last Last", 0.9), ("Asake", "Lonely at the Top", 0.8)
    got = timeline.collapse_runs(rows(spark, (0, 30, *b), (30, 60, "burna boy ", *b[1:]), (60, 90, *a), (90, 120, *a), (120, 150, *b)), "mix_id").orderBy("start_sec").collect()
    assert [(r.start_sec, r.end_sec, r.artist, r.n_merged) for r in got] == [(0, 60, "Burna Boy", 2), (60, 120, "Asake", 2), (120, 150, "Burna Boy", 1)]
    assert timeline.collapse_runs(rows(spark, (0, 1, *a)).limit(0), "mix_id").count() == 0


@pytest.mark.parametrize(
    ("known", "unknown", "most", "fills"),
    [
        ([(0, 30, "B", "L", 0.95), (60, 90, "b", "l ", 0.72)], [(30, 60)], 90, [("smoothed:acoustid", 0.72)]),
        ([(0, 30, "B", "L", 0.9), (60, 90, "A", "L", 0.9)], [(30, 60)], 90, []),
        ([(0, 30, "A", "X", 0.9), (200, 230, "A", "X", 0.9)], [(30, 200)], 60, []),
        ([(60, 90, "A", "X", 0.9)], [(0, 60), (90, 120)], 90, []),
        ([(0, 30, "A", "X", 0.9), (105, 135, "A", "X", 0.9)], [(30, 105)], 90, [("smoothed:acoustid", 0.9)]),
    ],
)
def test_smooth(spark, known, unknown, most, fills):
    filled, left = timeline.smooth_gaps(rows(spark, *known), unknowns(spark, *unknown), "mix_id", most)
    assert [(r.source, r.score) for r in filled.collect()] == fills
    assert left.count() == len(unknown) - len(fills)


def test_prefix_neighbour(spark):
    known = rows(spark, (0, 10, "A", "1", 1.0), (5, 100, "A", "2", 1.0), (20, 30, "A", "3", 1.0))
    got = timeline.neighbours(known, unknowns(spark, (40, 60)), "mix_id").head()
    assert got.before.title == "1" and got.after is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 40)), max_size=12), st.integers(0, 70), st.integers(0, 30))
def test_neighbours_equal_scan(spark, items, start, length):
    items = [(s, s + n, "A", str(k), 1.0) for k, (s, n) in enumerate(items)]
    before = after = None
    for r in sorted(items, key=lambda r: r[0]):
        if r[1] > start + 1:
            break
        if before is None or r[1] > before[1]:
            before = r
    after = next((r for r in sorted(items, key=lambda r: r[0]) if r[0] >= start + length - 1), None)
    data = [("m", i, float(r[0]), float(r[1]), *r[2:], "x") for i, r in enumerate(items)]
    got = timeline.neighbours(spark.createDataFrame(data, SCHEMA), unknowns(spark, (start, start + length)), "mix_id").head()
    assert (got.before and got.before.title) == (before and before[3]) and (got.after and got.after.title) == (after and after[3])


def test_anchor_fold_equals_scan(spark):
    r = random.Random(3)
    data = [(f"m{m}", k, float(r.randrange(200)), r.randrange(3)) for m in range(40) for k in range(r.randrange(1, 15))]
    want = set()
    for m in {d[0] for d in data}:
        kept = []
        for d in sorted((d for d in data if d[0] == m), key=lambda d: (d[2], -d[3], d[1])):
            if kept and abs(kept[-1][2] - d[2]) < 30:
                if d[3] > kept[-1][3]:
                    kept[-1] = d
            else:
                kept.append(d)
        want |= set(kept)
    df = spark.createDataFrame(data, "mix_id string, ord int, start_sec double, priority int").repartition(5)
    assert {tuple(x) for x in folds.anchor_fold(df, "mix_id", 30.0).collect()} == want


def test_gap_cap_and_segments(spark):
    bounds = spark.createDataFrame([("m", 10.0), ("m", 200.0), ("m", 200.0)], "mix_id string, t double")
    ends = spark.createDataFrame([("m", 300.0), ("e", 50.0)], "mix_id string, duration double")
    capped = timeline.gap_cap(bounds, ends, "mix_id")
    assert sorted((r.t, r.kind) for r in capped.where("mix_id = 'm'").collect()) == [(10, "orig"), (100, "gap"), (190, "gap"), (200, "orig"), (290, "gap")]
    got = timeline.segments(capped, ends, "mix_id").orderBy("mix_id", "start_sec").collect()
    assert [tuple(r) for r in got] == [("e", 0, 50, "start"), ("m", 0, 10, "start"), ("m", 10, 100, "orig"), ("m", 100, 190, "gap"), ("m", 190, 200, "gap"), ("m", 200, 290, "orig"), ("m", 290, 300, "gap")]


def test_spaced_top(spark):
    df = spark.createDataFrame([("m", 3, 5.0), ("m", 4, 9.0), ("m", 6, 8.0), ("m", 9, 7.0)], "mix_id string, idx int, score double")
    assert sorted(r.idx for r in folds.spaced_top(df, "mix_id", 3, 4).collect()) == [4, 9]


def test_overlay(spark):
    tracks = spark.createDataFrame([("m", i, float(s), s + 50.0, "audio", str(s), 0.9, "shazam", 1) for i, s in enumerate((0, 100, 200))], SCHEMA.replace("source string", "source string, n_merged long"))
    listed = spark.createDataFrame([("m", i, s, f"s{s}", "t", "mixesdb", 3) for i, s in enumerate((10.0, 20.0, 50.0, 130.0, 160.0))], "mix_id string, ord int, start_sec double, artist string, title string, source string, priority int")
    got = folds.overlay_names(tracks, listed, "mix_id")
    assert {r.start_sec: r.artist for r in got.collect()} == {0: "s10.0", 20: "s50.0", 100: "s130.0", 160: "s160.0", 200: "audio"}
    ends = timeline.refine_ends(got.withColumn("ord", got["n_merged"]), spark.createDataFrame([("m", 300.0)], "mix_id string, duration double"), "mix_id", ("mixesdb",))
    assert {r.start_sec: r.end_sec for r in ends.collect()} == {0: 20, 20: 100, 100: 160, 160: 200, 200: 250}


def test_bracket_is_inclusive(spark):
    for last, left in ((200.0, 0), (201.0, 1)):
        listed = spark.createDataFrame([("m", 20.0), ("m", last)], "mix_id string, start_sec double")
        assert timeline.bracketed(unknowns(spark, (80, 120)), listed, "mix_id").count() == left


def test_deep_scan(spark):
    for known, unknown, want in ((30, 10, True), (2, 3, True), (38, 2, False)):
        a = spark.createDataFrame([("m",)] * known, "mix_id string")
        assert timeline.deep_scan_gate(a, spark.createDataFrame([("m",)] * unknown, "mix_id string"), "mix_id").head().deep_scan is want


def test_dense_day_has_no_segment(spark, tmp_path):
    """A day with an event every four seconds keeps no segment; the SQL gives it no row, the operator by itself a tail."""
    import __spark_entry__ as entry
    import duckdb
    from pyspark.sql import functions as F

    dense = spark.range(21_600).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 4).cast("timestamp_ntz").alias("ts"))
    thin = spark.range(3).select((F.col("id") + 30_000).alias("event_id"), F.timestamp_seconds(1_704_153_600 + 100 + F.col("id") * 100).cast("timestamp_ntz").alias("ts"))
    dense.union(thin).selectExpr("*", "1L user_id", "'view' event_type", "1D value", "'' props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in DENSE:
        want = con.sql(entry.oracle_sql()[name]).fetchall()
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(want) and {r[0] for r in got} == {"2024-01-02"}
    ends = spark.createDataFrame([("e", 50.0)], "mix_id string, duration double")
    bounds = spark.createDataFrame([("e", float(t), "orig") for t in range(0, 50, 4)], "mix_id string, t double, kind string")
    assert [tuple(r) for r in timeline.segments(bounds, ends, "mix_id").collect()] == [("e", 0, 50, "end")]


DENSE = ("segments_from_boundaries", "long_segments")

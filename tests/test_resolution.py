"""The staged resolution, linear windows and the interval sweep."""

import random
import time

import pytest
from cuewright.operators import matching, resolution, timeline
from cuewright.sources.tables import Tables
from pyspark.sql import functions as F

SEGMENTS = "mix string, ord long, start_sec double, end_sec double"
LISTED = "mix string, ord long, start_sec double, artist string, title string, source string, priority int"
FOUND = "mix string, ord long, pick_rank int, artist string, title string, score double, source string"


def stage(spark, name, found, asked, keep=1):
    rows = spark.createDataFrame([("m", o, rank, a, a, s, name) for o, rank, a, s in found], FOUND)

    def match(open_):
        asked[name] = sorted(r["ord"] for r in open_.collect())
        return rows.join(open_.select("mix", "ord"), ["mix", "ord"])

    return resolution.Stage(name, match, keep)


def test_stages_get_open_segments_only(spark):
    asked = {}
    stages = [
        stage(spark, "library", [(0, 0, "A", 0.9), (0, 1, "B", 0.3), (1, 0, "C", 0.6), (1, 1, "D", 0.5), (1, 2, "E", 0.4), (1, 3, "F", 0.99)], asked, keep=3),
        stage(spark, "shazam", [(0, 0, "X", 1.0), (1, 1, "H", 1.0), (1, 0, "G", 0.7), (2, 0, "K", 0.85)], asked),
        stage(spark, "late", [(1, 0, "Z", 0.65), (2, 0, "Z", 1.0), (3, 0, "Z", 0.2)], asked),
    ]
    tables = Tables(spark, "test")
    segments = spark.createDataFrame([("m", i, 30.0 * i, 30.0 * i + 30) for i in range(5)], SEGMENTS)
    got = sorted((r["ord"], r["candidate_index"], r["artist"]) for r in resolution.match_stages(segments, stages, "mix", tables).collect())
    assert asked == {"library": [0, 1, 2, 3, 4], "shazam": [1, 2, 3, 4], "late": [1, 3, 4]}
    assert got == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C"), (1, 1, "D"), (1, 2, "E"), (1, 3, "G"), (1, 4, "Z"), (2, 0, "K"), (3, 0, "Z")]
    tables.drop()
    # the same by the rule over given matches, but for what a matcher that isn't asked can't know
    flat = [("m", o, k, rank, a, a, s, n) for k, (n, rows) in enumerate((("library", [(1, 0, "C", 0.6), (1, 1, "D", 0.5), (1, 2, "E", 0.4), (1, 3, "F", 0.99)]), ("shazam", [(1, 1, "H", 1.0), (1, 0, "G", 0.7)]), ("late", [(1, 0, "Z", 0.65)]))) for o, rank, a, s in rows]
    rows = spark.createDataFrame(flat, "mix string, ord long, stage int, pick_rank int, artist string, title string, score double, source string")
    assert [r["artist"] for r in matching.cascade(rows, ["mix", "ord"], keep={0: 3}).orderBy("candidate_index").collect()] == ["C", "D", "E", "G", "Z"]


def test_resolution_picks_retries_and_overlays(spark):
    asked = {}
    segments = spark.createDataFrame([("m", i, 30.0 * i, 30.0 * i + 30) for i in range(8)] + [("m", 8, 240.0, 245.0), ("sure", 0, 0.0, 30.0)], SEGMENTS)
    one = stage(spark, "library", [(0, 0, "A", 0.9), (1, 0, "A", 0.4), (1, 1, "B", 0.8), (3, 0, "A", 0.95), (4, 0, "C", 0.9), (7, 0, "D", 0.45)], asked, keep=3)
    listed = spark.createDataFrame([("m", 0, 205.0, "S", "s", "mixesdb", 3), ("m", 1, None, "U", "u", "mixesdb", 3), ("m", 2, None, "u ", "U!", "mixesdb", 3), *[("sure", k, 60.0 * k, "L", str(k), "mixesdb", 3) for k in range(10)]], LISTED)
    durations = spark.createDataFrame([("m", 300.0), ("sure", 600.0), ("none", 10.0)], "mix string, duration double")
    picks = lambda pools: pools.where("ord = 1 and candidate_index = 0").select("mix", "ord", "candidate_index")
    seen = []

    def stems(open_):
        seen.extend(sorted(r["ord"] for r in open_.collect()))
        return open_.where("ord in (5, 6)").select("mix", "ord", F.lit(0).alias("stem"), F.lit("R").alias("artist"), F.lit("R").alias("title"), F.when(F.col("ord") == 5, 0.9).otherwise(0.1).alias("score"))

    done = resolution.resolve(listed, segments, [one], durations, "mix", picks=picks, stems=stems, bracket=180.0)
    rows = [tuple(r)[1:] for r in done.where("mix = 'm'").orderBy("ord").collect()]
    assert asked["library"] == list(range(9)) and seen == [2, 5, 6, 7]  # not the one under eight seconds
    assert [(s, e, a, n) for _, s, e, a, _, _, _, n in rows] == [
        (0.0, 120.0, "A", 4), (120.0, 150.0, "C", 1), (150.0, 180.0, "R", 1), (205.0, 299.0 if False else 300.0, "S", 1), (210.0, 240.0, None, 0), (240.0, 245.0, None, 0), (299.0, 300.0, "U", 1)
    ]
    assert {r["source"] for r in done.where("mix = 'm'").collect()} == {"library", "shazam+demucs", "mixesdb", "unknown"}
    assert [r["artist"] for r in done.where("mix = 'sure'").collect()] == ["L"] * 10
    empty = resolution.resolve(listed.limit(0), segments.limit(0), [one], durations.limit(0), "mix")
    assert empty.count() == 0 and empty.columns == done.columns


def brute_neighbours(results, unknowns, slack=1.0):
    rows = sorted(results, key=lambda r: (r[1], r[0]))
    out = {}
    for o, us, ue in unknowns:
        lead = []
        for r in rows:
            if r[2] > us + slack:
                break
            lead.append(r)
        before = max(lead, key=lambda r: r[2], default=None)
        after = next((r for r in rows if r[1] >= ue - slack), None)
        out[o] = (before and before[3], after and after[3])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_equal_loops(spark, seed):
    rng = random.Random(seed)
    results = [(i, float(s), float(s + rng.choice([1, 2, 5])), f"t{i}") for i, s in enumerate(rng.choices(range(30), k=25))]
    unknowns = [(100 + i, float(s), float(s + rng.choice([0, 1, 4]))) for i, s in enumerate(rng.choices(range(30), k=15))]
    r = spark.createDataFrame([("m", o, s, e, t, t, 0.5, "x") for o, s, e, t in results], "mix string, ord int, start_sec double, end_sec double, artist string, title string, score double, source string")
    u = spark.createDataFrame([("m", o, s, e) for o, s, e in unknowns], "mix string, ord int, start_sec double, end_sec double")
    got = {x["ord"]: (x["before"] and x["before"]["title"], x["after"] and x["after"]["title"]) for x in timeline.neighbours(r, u, "mix").collect()}
    assert got == brute_neighbours(results, unknowns)


@pytest.mark.parametrize("seed", range(3))
def test_touching_equals_pairs(spark, seed):
    rng = random.Random(seed)
    spans = lambda n: [(rng.choice("ab"), i, float(s := rng.randrange(40)), float(s + rng.choice([0, 1, 3, -1]))) for i in range(n)]
    a, b = spans(40), spans(12)
    rows, others = (spark.createDataFrame([*x, (None, 99, 1.0, 5.0), ("a", 98, None, 5.0), ("a", 97, 1.0, None)], SEGMENTS) for x in (a, b))
    got = {(r["mix"], r["ord"]): r["touches"] for r in timeline.touching(rows, others, "mix").collect()}
    want = {(m, o): any(m == n and s < y and x < e for n, _, x, y in b) for m, o, s, e in a}
    assert got == want | {(None, 99): False, ("a", 98): False, ("a", 97): False}


def test_windows_grow_with_the_rows(spark):
    def took(n):
        rows = spark.range(n).select(F.lit("m").alias("mix"), F.col("id").alias("ord"), (F.col("id") * 2.0).alias("start_sec"), (F.col("id") * 2.0 + 1).alias("end_sec"), F.lit("a").alias("artist"), F.lit("b").alias("title"), F.lit(0.5).alias("score"), F.lit("x").alias("source"))
        asks = rows.select("mix", "ord", (F.col("start_sec") + 1).alias("start_sec"), (F.col("end_sec") + 1).alias("end_sec"))
        start = time.monotonic()
        assert timeline.smooth_gaps(rows, asks, "mix")[0].count() == n - 1
        assert timeline.bracketed(asks, rows, "mix").count() == 1
        assert timeline.touching(asks, rows, "mix").where("touches").count() == 0
        return time.monotonic() - start

    took(1_000)
    small, large = took(20_000), took(160_000)
    assert large < 24 * small  # eight times the rows; a quadratic frame takes 64 times as long

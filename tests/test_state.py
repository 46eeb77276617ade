"""Job states and caches on streams, against loops, over several batches and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from cuewright.streaming import state
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def brute_jobs(events, stuck):
    jobs, out = {}, []
    for job, ts, seq, event in sorted(events, key=lambda e: (e[1], e[2])):
        name, since = jobs.get(job, ("", ts))
        if name in state.OPEN_STATES and ts > since + timedelta(seconds=stuck):
            since += timedelta(seconds=stuck)
            out.append((job, since, "timeout", name, "error", True))
            name = "error"
        after = state.MOVES.get((name, event))
        out.append((job, ts, event, name, after or name, after is not None))
        jobs[job] = (after, ts) if after else (name, since)
    end = max(e[1] for e in events)
    for job, (name, since) in jobs.items():
        if name in state.OPEN_STATES and since + timedelta(seconds=stuck) < end:
            out.append((job, since + timedelta(seconds=stuck), "timeout", name, "error", True))
    return sorted(out)


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_job_states(spark, tmp_path, seed):
    rng, schema = random.Random(seed), "job string, ts timestamp, seq long, event string"
    events = [(f"j{rng.randrange(12)}", START + timedelta(seconds=20 * i), i, rng.choice(["create", "create", "start", "finish", "fail"])) for i in range(150)]
    own = state.stateful_session(spark)
    (tmp_path / "in").mkdir()
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (events[:60], events[60:100], events[100:]):  # restarts from its progress each time
        land(own, part, schema, f"{tmp_path}/in")
        state.run_stream(state.job_states(stream, 300), f"{tmp_path}/out")
    got = sorted(tuple(r) for r in own.read.parquet(f"{tmp_path}/out").collect())
    want = brute_jobs(events, 300)
    assert got == want and any(r[2] == "timeout" for r in got) and any(not r[5] for r in got)


def test_job_times_out_over_the_limit(spark, tmp_path):
    """A job that is open for exactly the limit when the stream's time ends isn't late yet, one a millisecond older is."""
    schema, own = "job string, ts timestamp, seq long, event string", state.stateful_session(spark)
    land(own, [("at", START, 1, "create"), ("over", START - timedelta(milliseconds=1), 2, "create"), ("end", START + timedelta(seconds=300), 3, "create")], schema, f"{tmp_path}/in")
    state.run_stream(state.job_states(own.readStream.schema(schema).parquet(f"{tmp_path}/in"), 300), f"{tmp_path}/out")
    assert [r.job for r in own.read.parquet(f"{tmp_path}/out").where("event = 'timeout'").collect()] == ["over"]


def test_jobs_share_groups(spark, tmp_path):
    """State is kept, and Python called, for a bucket of jobs and not for each job; each job times out at its own moment all the same."""
    rng, schema = random.Random(5), "job string, ts timestamp, seq long, event string"
    events = [(f"j{rng.randrange(300)}", START + timedelta(seconds=i), i, rng.choice(["create", "create", "start", "finish", "fail", "other"])) for i in range(1200)]
    own = state.stateful_session(spark)
    (tmp_path / "in").mkdir()
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (events[:500], events[500:900], events[900:]):
        land(own, part, schema, f"{tmp_path}/in")
        state.run_stream(state.job_states(stream, 120, buckets=8), f"{tmp_path}/out")
    assert own.read.format("statestore").option("stateVarName", "jobs").load(f"{tmp_path}/out-progress").count() == 8
    got = sorted(tuple(r) for r in own.read.parquet(f"{tmp_path}/out").collect())
    assert got == brute_jobs(events, 120) and sum(r[2] == "timeout" for r in got) > 100


def test_cache_equals_batch_rule(spark, tmp_path):
    rng, schema = random.Random(3), "g string, k string, ts long, v string"
    rows = [(rng.choice("ab"), f"k{rng.randrange(25)}", rng.randrange(0, 100_000), f"v{i}") for i in range(200)] + [("a", None, 5, "x")]
    own = state.stateful_session(spark)
    (tmp_path / "in").mkdir()
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (rows[:70], rows[70:90], rows[90:]):
        land(own, part, schema, f"{tmp_path}/in")
        state.run_stream(state.recent_entries(stream, "g", "k", "ts", "v", 40, 6), f"{tmp_path}/out", "update")
    changes = own.read.parquet(f"{tmp_path}/out")
    last = changes.groupBy("grp", "k").agg(F.max_by(F.struct("ts_ms", "v", "live"), "batch").alias("c")).where("c.live")
    got = sorted((r["grp"], r["k"], r["c"]["ts_ms"], r["c"]["v"]) for r in last.collect())
    want = []
    for g in "ab":
        latest = {}
        for own_g, k, ts, v in rows:
            if own_g == g and k:
                latest[k] = max(latest.get(k, (ts, v)), (ts, v))
        now = max(ts for ts, _ in latest.values())
        want += sorted(((g, k, ts, v) for k, (ts, v) in latest.items() if now - ts <= 40_000), key=lambda e: (-e[2], e[1]))[:6]
    assert got == sorted(want)

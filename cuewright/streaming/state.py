"""Keyed state with timers and expiry on streams: the states of jobs (inventory R, C12, C13) and result caches.

State lives in RocksDB, partitioned by key; a cache's state is small and bounded, a bucket of jobs holds an entry a job. Rows of a batch are taken in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Moves of a job, (state, event) to state. A job that ended doesn't move again.
MOVES = {("", "create"): "pending", ("pending", "start"): "running", ("pending", "fail"): "error", ("running", "finish"): "done", ("running", "fail"): "error"}
OPEN_STATES = ("pending", "running")
JOB = "job string, ms long, event string, before string, after string, accepted boolean"
_JOB_COLUMNS = ["job", "ms", "event", "before", "after", "accepted"]
#: Groups that jobs are dealt to by hash. A batch reads and writes the state of the groups that it has rows of; a stream keeps the number that it began with.
BUCKETS = 4096


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose streams keep state in RocksDB."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class JobMachine(StatefulProcessor):
    """The jobs of a bucket: each one's state, since when it has it, and a timer for the open job that times out first.

    A group is a bucket of jobs, not one job: each group costs calls between Python and the JVM, a job only its place in a list."""

    def __init__(self, stuck_ms: int):
        self.stuck_ms = stuck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", "jobs array<string>, names array<string>, sinces array<long>, due long")

    def _held(self) -> tuple[dict[str, tuple[str, int]], int | None]:
        """(name and since of each job, when the timer fires)."""
        if not self.state.exists():
            return {}, None
        jobs, names, sinces, due = self.state.get()
        return dict(zip(jobs, zip(names, sinces, strict=True), strict=True)), due

    def _put(self, held: dict[str, tuple[str, int]], before: int | None) -> None:
        # timers fire at their time already, a job times out over it
        due = min((since + self.stuck_ms + 1 for name, since in held.values() if name in OPEN_STATES), default=None)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((list(held), [name for name, _ in held.values()], [since for _, since in held.values()], due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ms", "seq"], kind="stable")
        held, due = self._held()
        out, changed = [], False
        for job, now, event in zip(batch["job"], batch["ms"].tolist(), batch["event"], strict=True):
            name, since = held.get(job, ("", 0))
            if name in OPEN_STATES and now > since + self.stuck_ms:
                # its timer would have fired before this row's time
                since += self.stuck_ms
                out.append((job, since, "timeout", name, "error", True))
                name, changed = "error", True
                held[job] = (name, since)
            after = MOVES.get((name, event))
            out.append((job, now, event, name, after or name, after is not None))
            if after:
                held[job], changed = (after, int(now)), True  # a null time in the bucket makes all of its times floats
        if changed:
            self._put(held, due)
        yield pd.DataFrame(out, columns=_JOB_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, due = self._held()
        if due is None or expiredTimerInfo.getExpiryTimeInMs() != due:
            return
        end, out = timerValues.getCurrentWatermarkInMs(), []
        for job, (name, since) in held.items():
            if name in OPEN_STATES and since + self.stuck_ms < end:
                held[job] = ("error", since + self.stuck_ms)
                out.append((job, since + self.stuck_ms, "timeout", name, "error", True))
        self._put(held, None)  # a timer that fired goes by itself
        yield pd.DataFrame(out, columns=_JOB_COLUMNS)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, stuck_seconds: int, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Every event of a stream (job, ts, seq, event: create, start, finish, fail) with the job's state before and after it, and whether
    it was a legal move; jobs that stay open over ``stuck_seconds`` time out to ``error`` by a row of their own, at the moment they do.

    Events of one job come in order of time from batch to batch; within one they are sorted by time, then ``seq``."""
    watched = events.withWatermark("ts", late).withColumns({"ms": F.unix_millis("ts"), "bucket": F.pmod(F.xxhash64("job"), F.lit(buckets))})
    moved = watched.groupBy("bucket").transformWithStateInPandas(JobMachine(stuck_seconds * 1000), JOB, "append", "eventTime")
    return moved.select("job", F.timestamp_millis("ms").alias("ts"), "event", "before", "after", "accepted")


class RecentCache(StatefulProcessor):
    """A group's newest entries: at most ``most`` keys, none older than ``ttl_ms`` before the newest time seen."""

    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "k string, ts long, v string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k: (ts, v) for k, ts, v in self.entries.get()} if self.entries.exists() else {}
        before = dict(held)
        for part in rows:
            for k, ts, v in zip(part["k"], part["ts_ms"].tolist(), part["v"], strict=True):
                if k not in held or (ts, v) > held[k]:
                    held[k] = (ts, v)
        now = max(ts for ts, _ in held.values())
        live = sorted(((-ts, k, v) for k, (ts, v) in held.items() if now - ts <= self.ttl_ms))[: self.most]
        kept = {k: (-ts, v) for ts, k, v in live}
        self.entries.put([(k, ts, v) for k, (ts, v) in kept.items()])
        changed = [(key[0], k, ts, v, True) for k, (ts, v) in kept.items() if before.get(k) != (ts, v)] + [(key[0], k, ts, v, False) for k, (ts, v) in before.items() if k not in kept]
        yield pd.DataFrame(changed, columns=["grp", "k", "ts_ms", "v", "live"])

    def close(self) -> None:
        pass


def recent_entries(entries: DataFrame, group: str, key: str, time_ms: str, value: str, ttl_seconds: int, most: int = 200) -> DataFrame:
    """Changes (grp, k, ts_ms, v, live) of each group's cache on a stream: entries that came or were renewed, and those that went because
    they are older than the time to live or more than ``most`` newer ones are there.

    The last change of every key, if live, is what the batch rule (K7-K9, I6) keeps, whatever the order of the rows: what has gone by either
    rule can't come back. Rows without key, time or value are left out."""
    rows = entries.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("string").alias("k"), F.col(time_ms).cast("long").alias("ts_ms"), F.col(value).cast("string").alias("v"))
    return rows.na.drop(subset=["k", "ts_ms", "v"]).groupBy("grp").transformWithStateInPandas(RecentCache(ttl_seconds * 1000, most), "grp string, k string, ts_ms long, v string, live boolean", "update", "none")


def run_stream(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Take what there is now, and write the stream's rows as Parquet to ``folder``, once each; state and progress stay beside it."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True)
    if mode == "append":
        query.format("parquet").option("path", folder).start().awaitTermination()
    else:
        query.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")).start().awaitTermination()

"""Queries of the stateful streams: all that is there now is taken, state and timers as in a running stream; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.sources.tables import Tables
from cuewright.streaming import state

STUCK = 4 * 3600


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as a job's: views create it, clicks start it, purchases finish it, errors fail it, sign-ups are no move."""
    own, tables = state.stateful_session(spark), Tables(spark, "jobs")
    kinds = F.create_map(*[F.lit(x) for x in ("view", "create", "click", "start", "purchase", "finish", "error", "fail")])
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job"), F.date_trunc("second", "ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"), F.coalesce(F.try_element_at(kinds, "event_type"), F.lit("other")).alias("event")
    )
    landed = tables.write(rows, "landed")  # a stream reads folders
    stream = own.readStream.schema(landed.schema).parquet(f"{tables.folder}/landed")
    state.run_stream(state.job_states(stream, STUCK), f"{tables.folder}/moves")
    return spark.read.parquet(f"{tables.folder}/moves").select("job", F.unix_seconds("ts").alias("at_sec"), "event", "before", "after", "accepted")


_MOVE_SQL = " ".join(f"WHEN now = '{before}' AND x.ev = '{event}' THEN '{after}'" for (before, event), after in state.MOVES.items())
JOBS_SQL = f"""WITH j AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS job, epoch_ms(date_trunc('second', ts)) // 1000 AS s, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'other' END AS ev FROM events),
l AS (SELECT job, list(struct_pack(s := s, ev := ev) ORDER BY s, seq) AS xs FROM j GROUP BY job),
f AS (SELECT job, list_reduce(xs, lambda k, x: list_concat(k, list_transform([len(k) > 0 AND k[-1].af IN ('pending', 'running') AND x.s > k[-1].si + {STUCK}], lambda late:
  list_transform([CASE WHEN late THEN 'error' ELSE coalesce(k[-1].af, '') END], lambda now: list_transform([CASE {_MOVE_SQL} END], lambda too:
    list_concat(CASE WHEN late THEN [struct_pack(s := k[-1].si + {STUCK}, ev := 'timeout', be := k[-1].af, af := 'error', ok := true, si := k[-1].si + {STUCK})] ELSE [] END,
      [struct_pack(s := x.s, ev := x.ev, be := now, af := coalesce(too, now), ok := too IS NOT NULL, si := CASE WHEN too IS NOT NULL THEN x.s WHEN late THEN k[-1].si + {STUCK} ELSE coalesce(k[-1].si, 0) END)]))[1])[1])[1]),
  []::STRUCT(s BIGINT, ev VARCHAR, be VARCHAR, af VARCHAR, ok BOOLEAN, si BIGINT)[]) AS k FROM l),
r AS (SELECT job, unnest(k) AS x FROM f)
SELECT job, x.s AS at_sec, x.ev AS event, x.be AS before, x.af AS after, x.ok AS accepted FROM r
UNION ALL SELECT job, k[-1].si + {STUCK}, 'timeout', k[-1].af, 'error', true FROM f WHERE k[-1].af IN ('pending', 'running') AND k[-1].si + {STUCK} < (SELECT max(s) FROM j)"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((job_states, JOBS_SQL),)}

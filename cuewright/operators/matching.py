"""Candidates, cascades, similarity and reconciliation (inventory C, F, G, K, M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import fold_key, same_key
from cuewright.operators.timeline import touching


def cascade(matches: DataFrame, key: list[str], floor: float = 0.85, stage: str = "stage", rank: str = "pick_rank", keep: dict[int, int] | None = None) -> DataFrame:
    """Candidates of staged matchers (C5, C6): a stage runs only while no earlier stage that ran scored ``floor`` or more. A sampled
    matcher's first hit (lowest ``rank``) counts; stages in ``keep`` pass on that many of their best ranks. All stages' matches are
    given; the rule picks those that would have run, ``candidate_index`` being their place."""
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in (keep or {}).items() for v in pair]), F.col(stage).cast("int")), F.lit(1)) if keep else F.lit(1)
    place = F.row_number().over(Window.partitionBy(*key, stage).orderBy(rank))
    kept = matches.withColumn("__place", place).where(F.col("__place") <= most)
    w = Window.partitionBy(*key).orderBy(stage)
    ran = kept.withColumn("__best", F.max("score").over(w.rangeBetween(Window.unboundedPreceding, -1))).where(F.col("__best").isNull() | (F.col("__best") < floor))
    index = F.row_number().over(Window.partitionBy(*key).orderBy(stage, "__place")) - 1
    return ran.select(*key, stage, index.alias("candidate_index"), "artist", "title", "score", "source")


def greedy_pick(candidates: DataFrame, key: list[str], floor: float = 0.5, order: str = "candidate_index") -> DataFrame:
    """The best candidate of each segment, first of equals, if it scores ``floor`` or more."""
    best = F.max_by(F.struct(order, "artist", "title", "score", "source"), F.struct("score", -F.col(order)))
    return candidates.groupBy(*key).agg(best.alias("b")).select(*key, "b.*").where(F.col("score") >= floor)


def apply_picks(candidates: DataFrame, picks: DataFrame, mix: str, segment: str) -> DataFrame:
    """Re-rank (M1, J11): recordings where no segment has two candidates go greedy; elsewhere a pick decides, a null pick or
    one out of range drops the segment (negative ones count from the end), and segments without pick go greedy."""
    per = candidates.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(mix, segment)))
    per = per.withColumn("ambiguous", F.max("n").over(Window.partitionBy(mix)) > 1)
    p = picks.select(mix, segment, F.col("candidate_index").alias("pick"), F.lit(True).alias("picked"))
    joined = per.join(p, [mix, segment], "left").withColumn("picked", F.coalesce("picked", F.lit(False)) & F.col("ambiguous"))
    wanted = F.when(F.col("pick") < 0, F.col("pick") + F.col("n")).otherwise(F.col("pick"))
    chosen = joined.where("picked").where(F.col("candidate_index") == wanted).select(mix, segment, "candidate_index", "artist", "title", "score", "source")
    return chosen.unionByName(greedy_pick(joined.where("not picked"), [mix, segment]))


def expanding_best(variants: DataFrame, key: list[str], pitch: str = "pitch", accept: float = 0.80, stop: float = 0.85) -> DataFrame:
    """The pitch variant that an outward search finds (G6): the first at ``stop`` or more by distance from 0, else the best at
    ``accept`` or more, first of equals."""
    rank = F.struct(F.abs(pitch).alias("d"), F.col(pitch).alias("p"))
    row = F.struct(pitch, "score")
    sure = F.min_by(F.when(F.col("score") >= stop, row), F.when(F.col("score") >= stop, rank))
    order = -(F.abs(pitch) * 2 + (F.col(pitch) > 0).cast("int"))
    fair = F.max_by(F.when(F.col("score") >= accept, row), F.when(F.col("score") >= accept, F.struct("score", order)))
    return variants.groupBy(*key).agg(F.coalesce(sure, fair).alias("b")).where("b is not null").select(*key, f"b.{pitch}", "b.score")


def upper_median_gate(scores: DataFrame, key: list[str], most: float = 0.80, middle: float = 0.65) -> DataFrame:
    """Groups whose best score and upper median reach the floors."""
    sorted_ = F.array_sort(F.collect_list("score"))
    rows = scores.groupBy(*key).agg(F.max("score").alias("best"), sorted_.alias("s")).select(*key, "best", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("median"))
    return rows.where((F.col("best") >= most) & (F.col("median") >= middle))


def duration_factor(score: Column, duration: Column, least: float = 300.0) -> Column:
    """Short candidates count for less (M4)."""
    return score * F.when(duration < least, 0.6).otherwise(1.0)


def tier2_merge(tracks: DataFrame, unknowns: DataFrame, matches: DataFrame, key: str, floor: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(tracks with second-tier matches added, unknowns left) (N2, J4, J5): matches at ``floor`` or more that overlap an unknown
    are added, and every unknown that an added track overlaps goes."""
    good = touching(matches.where(F.col("score") >= floor), unknowns, key).where("touches")
    added = good.select(key, "ord", "start_sec", "end_sec", "artist", "title", "score", F.concat(F.lit("tier2:acoustid_vocals(pitch="), F.format_string("%+d", "pitch"), F.lit("%)")).alias("source"))
    left = touching(unknowns, added, key).where("not touches").drop("touches")
    return tracks.select(key, "ord", "start_sec", "end_sec", "artist", "title", "score", "source").unionByName(added), left


def drop_known_names(untimed: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """Untimed entries whose folded name no track has, once each, first wins."""
    named = untimed.withColumn("a", fold_key("artist")).withColumn("t", fold_key("title"))
    known = tracks.select(key, fold_key("artist").alias("a"), fold_key("title").alias("t")).distinct()
    fresh = named.join(known, [key, "a", "t"], "left_anti")
    w = Window.partitionBy(key, "a", "t").orderBy("ord")
    return fresh.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "a", "t")


def library_upsert(library: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The library after a batch (J10, K3, K4): keys that it has are skipped; of a new key's rows the last stays."""
    fresh = batch.join(library.select(key), key, "left_anti")
    last = fresh.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select(key, "r.*")
    return library.unionByName(last.select(library.columns))


def library_lookup(tracks: DataFrame, library: DataFrame, order: str) -> DataFrame:
    """Tracks with the path that the library has for their lower-cased names, the last of several."""
    names = F.concat(same_key("artist"), F.lit("|"), same_key("title"))
    paths = library.groupBy(names.alias("name_key")).agg(F.max_by("filepath", order).alias("filepath"))
    return tracks.withColumn("name_key", names).join(paths, "name_key", "left").drop("name_key")


def ttl_cache(entries: DataFrame, key: str, now: Column, ttl: float, most: int | None = None) -> DataFrame:
    """The latest entry of each key that isn't older than ``ttl`` (K7-K9), at most the ``most`` newest."""
    latest = entries.groupBy(key).agg(F.max(F.struct("ts", *[c for c in entries.columns if c not in (key, "ts")])).alias("e")).select(key, "e.*")
    live = latest.where(now - F.col("ts") <= ttl)
    return live if most is None else live.orderBy(F.desc("ts"), key).limit(most)


def top_per_group(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of every group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def pages_of(limits: DataFrame, limit: str, page: int = 25) -> DataFrame:
    """The page requests of a paged scan (A6): (…, page_no, page_size), the last one short; no rows for limits under 1."""
    rows = limits.where(F.col(limit) > 0).withColumn("page_no", F.explode(F.sequence(F.lit(0), (F.ceil(F.col(limit) / page) - 1).cast("int"))))
    return rows.withColumn("page_size", F.least(F.lit(page), F.col(limit) - F.col("page_no") * page))


def queue_state(jobs: DataFrame, group: str) -> DataFrame:
    """Depth, state and waiting time of a queue of jobs."""
    d = F.col("depth")
    rows = jobs.groupBy(group).agg(F.count_if(F.col("status").isin("pending", "running")).alias("depth"))
    state = F.when(d == 0, "free").when(d <= 2, "busy").otherwise("swamped")
    return rows.select(group, "depth", state.alias("state"), F.floor(30 * (d + 0.5)).cast("long").alias("eta_minutes"))


def usage_stats(runs: DataFrame) -> DataFrame:
    """Number of runs, seconds and tracks (G1)."""
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"), F.coalesce(F.sum("identified"), F.lit(0)).alias("total_tracks"))

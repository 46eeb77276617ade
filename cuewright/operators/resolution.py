"""The resolution of recordings end to end (inventory N3), in stages: each step sees only the recordings and segments that are still open.

What is open is a table that one step writes and the next reads, so nothing is planned or computed twice, a slow matcher is only asked
where the ones before it weren't sure, and a lost executor costs no more than a step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators import catalogue, library, matching, timeline
from cuewright.operators.overlay import COLUMNS, overlay
from cuewright.sources.tables import Tables


@dataclass(frozen=True)
class Stage:
    """A matcher: ``match`` gives (key, ord, pick_rank, artist, title, score, source) for the open segments (key, ord, start_sec, end_sec) that it
    gets; of a segment's ranks the first ``keep`` are candidates, one for a matcher that is tried place by place (C6)."""

    name: str
    match: Callable[[DataFrame], DataFrame]
    keep: int = 1


def match_stages(segments: DataFrame, stages: list[Stage], key: str, tables: Tables, floor: float = library.FLOORS["library"]) -> DataFrame:
    """Candidates (key, ord, candidate_index, artist, title, score, source) of staged matchers (C5): a stage gets the segments whose best score so
    far is below ``floor``."""
    one = [key, "ord"]
    frontier = tables.write(segments.select(*one, "start_sec", "end_sec", F.lit(None).cast("double").alias("best")), "open-0")
    pools = []
    for i, stage in enumerate(stages):
        found = stage.match(frontier.drop("best")).select(*one, "pick_rank", "artist", "title", "score", "source")
        place = F.row_number().over(Window.partitionBy(*one).orderBy("pick_rank"))
        pool = tables.write(found.withColumn("place", place).where(F.col("place") <= stage.keep), f"pool-{i}")
        pools.append(pool.withColumn("stage", F.lit(i)))
        if i + 1 < len(stages):
            best = pool.groupBy(*one).agg(F.max("score").alias("now"))
            after = frontier.join(best, one, "left").withColumn("best", F.greatest("best", "now")).drop("now")
            frontier = tables.write(after.where(F.col("best").isNull() | (F.col("best") < floor)), f"open-{i + 1}")
            tables.drop(f"open-{i}")
    rows = pools[0]
    for more in pools[1:]:
        rows = rows.unionByName(more)
    index = (F.row_number().over(Window.partitionBy(*one).orderBy("stage", "place")) - 1).alias("candidate_index")
    return tables.write(rows.select(*one, index, "artist", "title", "score", "source"), "pools")


def retry_stems(
    unknowns: DataFrame, stems: Callable[[DataFrame], DataFrame], key: str, tables: Tables, cap: int = 20, least: float = 8.0
) -> tuple[DataFrame, DataFrame]:
    """(rescued, unknowns left) of the slow pass (M3, I3): the ``cap`` longest unknowns of each recording, if not too short, go to ``stems``, which gives
    (key, ord, stem, artist, title, score). A rescue below the greedy floor is neither rescued nor left."""
    tried = tables.write(timeline.longest_unknowns(unknowns, key, cap, "late", "ord"), "tried")
    asked = tried.where(F.col("retry") & (F.col("end_sec") - F.col("start_sec") >= least)).select(key, "ord", "start_sec", "end_sec")
    matches = tables.write(stems(asked).select(key, "ord", "stem", "artist", "title", "score"), "stems")
    rescued, left = catalogue.stem_retry(tried, matches, key, least)
    return rescued.where(F.col("score") >= library.FLOORS["greedy"]), left


def resolve(
    listed: DataFrame, segments: DataFrame, stages: list[Stage], durations: DataFrame, key: str, *, picks: Callable[[DataFrame], DataFrame] | None = None,
    stems: Callable[[DataFrame], DataFrame] | None = None, deep: bool | None = None, longest_gap: float = 90.0, bracket: float = 180.0, cap: int = 20,
) -> DataFrame:
    """Every recording from its segments, matchers and listed entries to its rows (key, ord, start, end, artist, title, score, source, n_merged).

    Where listed entries suffice, they are the result (C3, C2). Elsewhere: matchers in stages (C5); of the candidates ``picks`` chooses, given them all
    (M1), else the best from 0.5 counts (G3); segments without one are unknown (C7). Where ``deep``, by default where many are unknown
    (C4), ``stems`` retries the longest. Gaps between equal tracks are filled (H3), runs collapse (H1), listed entries are overlaid, unknowns that they
    explain go and untimed ones (null start) follow at the end (N1). Unknowns have source ``unknown`` and null names. ``ord`` numbers a recording's rows by
    start, then by their other columns.

    ``listed``: key, ord, start_sec, artist, title, source, priority; ``segments``: key, ord, start_sec, end_sec; ``durations``: key,
    duration, a row for every recording. Empty tables give no rows. The result is a table that stays in the shared folder.
    """
    spark = segments.sparkSession
    tables, results = Tables(spark, "resolution"), Tables(spark, "resolved")
    one = [key, "ord"]
    entries = tables.write(listed.select(*one, "start_sec", "artist", "title", "source", "priority"), "listed")
    gate = tables.write(timeline.coverage_gate(entries, durations, key).join(durations, key), "gate")
    closed, lasting = gate.where("short_circuit").select(key), gate.where("not short_circuit").select(key, "duration")
    promoted = timeline.promote_entries(entries.join(closed, key, "left_semi"), key).select(key, *COLUMNS)

    parts = tables.write(segments.join(lasting, key, "left_semi").select(*one, "start_sec", "end_sec"), "segments")
    pools = match_stages(parts, stages, key, tables)
    chosen = matching.apply_picks(pools, picks(pools), key, "ord") if picks else matching.greedy_pick(pools, one, library.FLOORS["greedy"])
    # a segment's row says how it fared: chosen names, or late if it had candidates
    fared = parts.join(chosen.select(*one, "artist", "title", "score", "source"), one, "left").join(pools.select(*one).distinct().withColumn("late", F.lit(True)), one, "left")
    fared = tables.write(fared.withColumn("late", F.coalesce("late", F.lit(False))), "fared")
    known, unknown = fared.where("source is not null").drop("late"), fared.where("source is null").select(*one, "start_sec", "end_sec", "late")

    if stems is not None and deep is not False:
        goes = timeline.deep_scan_gate(fared.where("late"), unknown, key).where(F.lit(bool(deep)) | F.col("deep_scan")).select(key)
        rescued, left = retry_stems(unknown.join(goes, key, "left_semi"), stems, key, tables, cap)
        known = known.unionByName(rescued.select(known.columns))
        unknown = unknown.drop("late").join(goes, key, "left_anti").unionByName(left.select(*one, "start_sec", "end_sec"))
    fills = tables.write(timeline.gap_fills(known, unknown.select(*one, "start_sec", "end_sec"), key, longest_gap), "fills")
    runs = timeline.collapse_runs(known.unionByName(fills.where("fills").select(known.columns)), key)
    open_entries = entries.join(lasting, key, "left_semi")
    rows = overlay(runs, open_entries.where("start_sec is not null"), open_entries.where("start_sec is null"), fills.where("not fills").select(*one, "start_sec", "end_sec"), lasting, key, bracket, tables.write)
    number = F.row_number().over(Window.partitionBy(key).orderBy("start_sec", "end_sec", "source", "artist", "title", "score"))
    done = results.write(promoted.unionByName(rows).select(key, number.alias("ord"), *COLUMNS), "rows")
    tables.drop()
    return done

"""The overlay of listed entries on recognised tracks as a whole (inventory N1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.operators import catalogue, folds, matching, timeline

COLUMNS = ("start_sec", "end_sec", "artist", "title", "score", "source", "n_merged")


def overlay(
    tracks: DataFrame, listed: DataFrame, untimed: DataFrame, unknowns: DataFrame, durations: DataFrame, key: str, most: float = 180.0, hold: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> DataFrame:
    """Rows (key, start, end, artist, title, score, source, n_merged) of all recordings after the five rules, in their order.

    Listed entries name the nearest tracks or become tracks of their own; tracks that they name end where the next track
    starts; unknowns between two listed starts at most ``most`` apart go, the others have source ``unknown`` and null names; untimed
    entries that no track has come at the end. The inputs are those of the single rules. Recordings without tracks keep their listed
    entries and unknowns. ``hold`` may write what is read twice to a table.
    """
    named = folds.overlay_names(tracks, listed, key).withColumn("ord", F.lit(0))
    named = hold(timeline.refine_ends(named, durations, key).select(key, *COLUMNS), "named")
    tail = catalogue.untimed_tail(matching.drop_known_names(untimed, named, key), durations, key).select(key, *COLUMNS)
    left = timeline.bracketed(unknowns, listed, key, most)
    no = F.lit(None)
    rest = left.select(key, "start_sec", "end_sec", no.cast("string").alias("artist"), no.cast("string").alias("title"), no.cast("double").alias("score"), F.lit("unknown").alias("source"), F.lit(0).cast("long").alias("n_merged"))
    return named.unionByName(tail).unionByName(rest)

"""Ordered folds per recording (inventory H2, H6, H10, J3): each step depends on what was kept before.

They run as grouped maps with loops of a few lines. A group is a stretch of a recording between gaps across which rows can't affect
each other, so a long recording is many groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a recording in one group, unless a longer stretch hangs together.
ROWS = 10_000


def _per_group(df: DataFrame, keys: list[str], pick) -> DataFrame:
    """Keep the rows that ``pick(pdf) -> positions`` chooses in each group."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: pdf.iloc[pick(pdf)], df.schema)


def stretches(df: DataFrame, key: str, start: str, apart: Callable[[Column], Column], name: str = "stretch") -> DataFrame:
    """Add a number that the rows of a stretch share: a new one may only start where ``apart`` holds for the time since the row before.
    Short stretches in a row share a number, ``ROWS`` rows or little more."""
    w = Window.partitionBy(key).orderBy(start)
    fresh = F.coalesce(apart(F.col(start) - F.lag(start).over(w)), F.lit(True))
    begun = F.max(F.when(F.col("__fresh"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"__fresh": fresh, "__n": F.row_number().over(w)}).withColumn(name, F.floor(begun / ROWS)).drop("__fresh", "__n")


def anchor_fold(df: DataFrame, key: str, window: float, start: str = "start_sec", priority: str = "priority", order: str = "ord") -> DataFrame:
    """Windowed priority dedup (H2, H6): by start, then priority, then order. A row less than ``window`` after the last kept
    row goes, or takes its place, and moves the anchor, if its priority is strictly higher. A row ``window`` or more after the row before
    it always stays, so stretches between such rows are folded apart.

    Rows with null starts must be left out before. Empty input gives no rows.
    """

    def pick(pdf: pd.DataFrame) -> list[int]:
        by = pdf.reset_index(drop=True).sort_values([start, priority, order], ascending=[True, False, True], kind="stable")
        kept: list[int] = []
        last_start = last_priority = 0.0
        for i, s, p in zip(by.index, by[start], by[priority], strict=True):
            if kept and abs(last_start - s) < window:
                if p <= last_priority:
                    continue
                kept[-1] = i
            else:
                kept.append(i)
            last_start, last_priority = s, p
        return kept

    return _per_group(stretches(df, key, start, lambda gap: gap >= window, "__stretch"), [key, "__stretch"], pick).drop("__stretch")


def spaced_top(df: DataFrame, key: str, k: int, gap: int, index: str = "idx", score: str = "score") -> DataFrame:
    """The ``k`` best-scored rows of a group whose positions are more than ``gap`` apart (H10); ties go to the lower position.

    A pick rules out ``2 * gap + 1`` positions, so only that many times ``k`` of a group's best rows, one a position, can matter: the others
    are cut by partial top rows before the shuffle, and the greedy pick holds few rows whatever the group's size."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        by = pdf.reset_index(drop=True).sort_values([score, index], ascending=[False, True], kind="stable")
        kept: list[int] = []
        places: list[int] = []
        for i, p in zip(by.index, by[index], strict=True):
            if all(abs(p - q) > gap for q in places):
                kept.append(i)
                places.append(p)
            if len(kept) == k:
                break
        return kept

    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), index))
    one = df.withColumn("__n", best(key, index)).where("__n = 1").drop("__n")
    most = one.withColumn("__n", best(key)).where(F.col("__n") <= k * (2 * gap + 1)).drop("__n")
    return _per_group(most, [key], pick)


def overlay_names(tracks: DataFrame, scraped: DataFrame, key: str, window: float = 30.0, placeholder: float = 60.0) -> DataFrame:
    """Greedy nearest match of listed entries onto tracks (J3): a listed entry, by start and order, names the nearest track that no
    entry has claimed, within ``window`` seconds inclusive, if its priority is above 0; else it becomes a track of its own.

    ``tracks``: key, ord, start_sec, end_sec, artist, title, score, source, n_merged; ``scraped``: key, ord, start_sec, artist,
    title, source, priority. Tracks that entries became can still be named by a later entry. Tracks that an entry named or became
    have ``listed``.
    """
    schema = tracks.select(key, "start_sec", "end_sec", "artist", "title", "score", "source", "n_merged", F.lit(False).alias("listed")).schema
    columns = schema.names

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = left.sort_values("ord", kind="stable")[columns].to_dict("records") if len(left) else []
        free = sorted((t["start_sec"], i) for i, t in enumerate(own))  # those that no entry has claimed
        for s in right.sort_values(["start_sec", "ord"], kind="stable").to_dict("records") if len(right) else []:
            near = free[bisect_left(free, (s["start_sec"] - window,)) : bisect_right(free, (s["start_sec"] + window, len(own)))]
            named = {"artist": s["artist"], "title": s["title"], "score": 1.0, "source": s["source"], "listed": True}
            if near and s["priority"] > 0:
                start, i = min(near, key=lambda t: (abs(t[0] - s["start_sec"]), t[1]))
                own[i] |= named
                del free[bisect_left(free, (start, i))]
            else:
                insort(free, (s["start_sec"], len(own)))
                own.append({key: s[key], "start_sec": s["start_sec"], "end_sec": s["start_sec"] + placeholder, "n_merged": 1} | named)
        return pd.DataFrame(own, columns=columns)

    # new columns: both sides may come from one table, and a cogroup confuses shared ones
    own = tracks.select(*[F.col(c).alias(c) for c in (*columns[:-1], "ord")], F.lit(False).alias("listed"))
    listed = scraped.where("start_sec is not null").select(*[F.col(c).alias(c) for c in (key, "ord", "start_sec", "artist", "title", "source", "priority")])
    # an entry only names a track within the window, so nothing reaches across a longer gap in which neither starts
    starts = own.select(key, "start_sec").unionByName(listed.select(key, "start_sec")).distinct()
    part = stretches(starts, key, "start_sec", lambda gap: gap > window)
    own, listed = (side.join(part, [key, "start_sec"]).select(*[F.col(c).alias(c) for c in (*side.columns, "stretch")]) for side in (own, listed))
    out = own.groupBy(key, "stretch").cogroup(listed.groupBy(key, "stretch")).applyInPandas(merge, schema)
    return out.select(*[F.col(c) for c in columns])

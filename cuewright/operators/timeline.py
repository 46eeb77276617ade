"""Windows over one recording's timeline (inventory G, H, J1, J2, J7): runs, gaps, boundaries, as-of neighbours.

Every operator partitions by the recording's key and sorts once. Rows carry ``ord``, since order decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import same_key


def track_key() -> Column:
    return F.struct(same_key("artist"), same_key("title"))


def collapse_runs(results: DataFrame, key: str) -> DataFrame:
    """Adjacent rows of one track become one (H1, G2): first start, last row's end, best score with its names and source (the
    first of equals), number of rows. A track that comes again later is a run of its own."""
    w = Window.partitionBy(key).orderBy("start_sec", "ord")
    rows = results.withColumn("k", track_key()).withColumn("rank", F.row_number().over(w))
    rows = rows.withColumn("new", (~F.col("k").eqNullSafe(F.lag("k").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    best = F.max_by(F.struct("artist", "title", "score", "source"), F.struct("score", -F.col("rank")))
    return rows.groupBy(key, "run").agg(F.min_by("start_sec", "rank").alias("start_sec"), F.max_by("end_sec", "rank").alias("end_sec"), best.alias("b"), F.count(F.lit(1)).alias("n_merged")).select(
        key, F.col("run").alias("ord"), "start_sec", "end_sec", "b.artist", "b.title", "b.score", "b.source", "n_merged"
    )


def neighbours(results: DataFrame, unknowns: DataFrame, key: str, slack: float = 1.0) -> DataFrame:
    """``unknowns`` (key, ord, start_sec, end_sec) with structs ``before`` and ``after``.

    ``before`` is the latest-ending row (first of equals) among the leading rows that all end by the unknown's start plus
    ``slack``; ``after`` the first row that starts at its end minus ``slack`` or later. ``results`` are read once; no range join.
    """
    w = Window.partitionBy(key).orderBy("start_sec", "ord")
    payload = F.struct("start_sec", "end_sec", "artist", "title", "score", "source")
    ranked = results.withColumn("rank", F.row_number().over(w))
    leading = ranked.withColumn("reach", F.max("end_sec").over(w)).withColumn("latest", F.max(F.struct("end_sec", -F.col("rank"), payload.alias("row"))).over(w)["row"])
    none, empty = F.lit(None).cast("double"), F.lit(None).cast(leading.schema["latest"].dataType)
    # each row marks two places: where all rows up to it have ended (1), and where it starts (2); each unknown asks at two (3, 0)
    mark = lambda t, kind, row: F.struct(t.alias("t"), F.lit(kind).alias("kind"), row.alias("row"))
    marks = leading.select(key, F.explode(F.array(mark(F.col("reach"), 1, F.col("latest")), mark(F.col("start_sec"), 2, payload))).alias("m"), "rank", none.alias("start_sec"), none.alias("end_sec"))
    asks = unknowns.select(key, F.explode(F.array(mark(F.col("start_sec") + slack, 3, empty), mark(F.col("end_sec") - slack, 0, empty))).alias("m"), F.col("ord").alias("rank"), "start_sec", "end_sec")
    both = marks.unionByName(asks).select(key, "m.*", "rank", "start_sec", "end_sec")
    # both frames run from their order's start: what follows is what went before in the opposite order
    upto = lambda *order: Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("row")), ignorenulls=True)
    before = both.where("kind <> 2").withColumn("found", last(1).over(upto("t", "kind", "rank"))).where("kind = 3")
    after = both.where("kind in (0, 2)").withColumn("found", last(2).over(upto(F.desc("t"), F.desc("kind"), F.desc("rank")))).where("kind = 0")
    found = before.unionByName(after).groupBy(key, F.col("rank").alias("ord")).agg(F.first("start_sec").alias("start_sec"), F.first("end_sec").alias("end_sec"), F.max(F.when(F.col("kind") == 3, F.col("found"))).alias("before"), F.max(F.when(F.col("kind") == 0, F.col("found"))).alias("after"))
    return found


def gap_fills(results: DataFrame, unknowns: DataFrame, key: str, most: float = 90.0) -> DataFrame:
    """``unknowns`` with ``fills``, whether they lie between two rows of one track and last at most ``most`` seconds, and the names,
    score and source that they take then: those of the row before, the lower score, ``smoothed:`` before the source."""
    around = neighbours(results, unknowns, key)
    same = (same_key("before.artist") == same_key("after.artist")) & (same_key("before.title") == same_key("after.title"))
    around = around.withColumn("fills", F.coalesce((F.col("end_sec") - F.col("start_sec") <= most) & same, F.lit(False)))
    return around.select(
        key, "ord", "start_sec", "end_sec", "fills", "before.artist", "before.title", F.least("before.score", "after.score").alias("score"), F.concat(F.lit("smoothed:"), "before.source").alias("source")
    )


def smooth_gaps(results: DataFrame, unknowns: DataFrame, key: str, most: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """(filled rows, unknowns left) (H3) of ``gap_fills``."""
    rows = gap_fills(results, unknowns, key, most)
    return rows.where("fills").drop("fills"), rows.where("not fills").select(key, "ord", "start_sec", "end_sec")


def gap_cap(bounds: DataFrame, durations: DataFrame, key: str, most: float = 90.0) -> DataFrame:
    """(key, t, kind): distinct boundaries plus one every ``most`` seconds in longer gaps, those to the end included (H7)."""
    w = Window.partitionBy(key).orderBy("t")
    ends = durations.select(key, F.col("duration").alias("t"), F.lit(True).alias("is_end"))
    points = bounds.select(key, "t").distinct().withColumn("is_end", F.lit(False)).unionByName(ends)
    w = Window.partitionBy(key).orderBy("t", "is_end")
    gaps = points.withColumn("before", F.coalesce(F.lag("t").over(w), F.lit(0.0))).withColumn("gap", F.col("t") - F.col("before"))
    n = F.ceil(F.col("gap") / most).cast("int") - 1
    inner = gaps.where(F.col("gap") > most).select(key, F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("i"), "before").select(key, (F.col("before") + F.col("i") * most).alias("t"), F.lit("gap").alias("kind"))
    return points.where("not is_end").select(key, "t", F.lit("orig").alias("kind")).unionByName(inner)


def segments(bounds: DataFrame, durations: DataFrame, key: str, least: float = 5.0, longer: bool = False, bare: bool = True) -> DataFrame:
    """Segments between consecutive boundaries (key, t, kind), 0 and the duration being boundaries too (H8); those under
    ``least`` seconds go, with ``longer`` (H13) those of just as many too; a tail follows if the last segment ends over a second early.
    A recording of which no segment is left is one tail, without ``bare`` it has no row."""
    marks = durations.select(key, F.lit(0.0).alias("t"), F.lit("start").alias("kind")).unionByName(bounds.select(key, "t", "kind"))
    w = Window.partitionBy(key).orderBy("t", "kind")
    rows = marks.join(durations, key).withColumn("end_sec", F.coalesce(F.lead("t").over(w), F.col("duration")))
    length = F.col("end_sec") - F.col("t")
    kept = rows.where(length > least if longer else length >= least).select(key, F.col("t").alias("start_sec"), "end_sec", F.col("kind").alias("boundary"))
    last = durations.join(kept.groupBy(key).agg(F.max("end_sec").alias("last")), key, "left" if bare else "inner").withColumn("last", F.coalesce("last", F.lit(0.0)))
    tail = last.where(F.col("last") < F.col("duration") - 1).select(key, F.col("last").alias("start_sec"), F.col("duration").alias("end_sec"), F.lit("end").alias("boundary"))
    return kept.unionByName(tail)


def phrase_grid(beats: DataFrame, key: str, every: int = 64) -> DataFrame:
    """Every ``every``-th beat (key, t) after the first (H9)."""
    rows = beats.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("t", "ord")) - 1)
    return rows.where((F.col("i") > 0) & (F.col("i") % every == 0)).select(key, "t", "i")


def framed_rms(samples: DataFrame, key: str, size: int, hop: int) -> DataFrame:
    """Root mean square of frames of ``size`` samples every ``hop`` (H11, Q5): (key, frame, rms); short tails have none. Frames are
    differences of running sums, so a sample is added once whatever the frame's size."""
    w = Window.partitionBy(key).orderBy("i")
    square = F.col("x") * F.col("x")
    rows = samples.withColumn("s2", square).withColumn("upto", F.sum("s2").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("upto", size - 1).over(w))
    whole = rows.where(F.col("end").isNotNull() & (F.col("i") % hop == 0))
    return whole.select(key, F.floor(F.col("i") / hop).alias("frame"), F.sqrt(F.greatest(F.lit(0.0), F.col("end") - F.col("upto") + F.col("s2")) / size).alias("rms"))


def loudest_window(frames: DataFrame, key: str) -> DataFrame:
    """The frame of the highest rms in each group, the first of equals."""
    return frames.groupBy(key).agg(F.max_by(F.struct("frame", "rms"), F.struct("rms", -F.col("frame"))).alias("b")).select(key, "b.*")


def z_scores(rows: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """Score against the group's mean and population deviation."""
    w = Window.partitionBy(key)
    return rows.withColumn(out, (F.col(column) - F.avg(column).over(w)) / (F.stddev_pop(column).over(w) + 1e-9))


def promote_entries(scraped: DataFrame, key: str) -> DataFrame:
    """Listed entries as tracks (C2): the end is the next entry's start if it has one, else a minute after the own start."""
    w = Window.partitionBy(key).orderBy("ord")
    start = F.coalesce("start_sec", F.lit(0.0))
    return scraped.select(
        key, "ord", start.alias("start_sec"), F.coalesce(F.lead("start_sec").over(w), start + 60).alias("end_sec"), "artist", "title", F.lit(1.0).alias("score"), "source", F.lit(1).cast("long").alias("n_merged")
    )


def coverage_gate(scraped: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Whether a recording's listed entries suffice (C3, G8): the last at 80 % or later, one in three minutes, no gap over 300 s."""
    timed = scraped.where("start_sec is not null")
    gap = F.col("start_sec") - F.lag("start_sec", 1, 0.0).over(Window.partitionBy(key).orderBy("start_sec", "ord"))
    stats = timed.withColumn("gap", gap).groupBy(key).agg(F.max("start_sec").alias("last"), F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap"))
    d = F.col("duration")
    passes = (d > 0) & (F.col("last") / d >= 0.8) & (F.col("n") / (d / 60) >= 1 / 3) & (F.greatest("gap", d - F.col("last")) <= 300)
    return durations.join(stats, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_timed"), F.coalesce(passes, F.lit(False)).alias("short_circuit"))


def bracketed(unknowns: DataFrame, scraped: DataFrame, key: str, most: float = 180.0) -> DataFrame:
    """Unknowns that no two listed starts around their middle, at most ``most`` apart, explain."""
    starts = scraped.where("start_sec is not null").select(key, F.col("start_sec").alias("t")).distinct()
    points = starts.select(key, "t", F.lit(None).cast("long").alias("ord"), F.col("t").alias("s"))
    asks = unknowns.select(key, ((F.col("start_sec") + F.col("end_sec")) / 2).alias("t"), "ord", F.lit(None).cast("double").alias("s"))
    # a listed start comes before the middles at its place in both orders, so it counts on both sides
    nearest = lambda order: F.last("s", ignorenulls=True).over(Window.partitionBy(key).orderBy(order, F.col("ord").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = points.unionByName(asks).withColumn("before", nearest(F.col("t"))).withColumn("after", nearest(F.desc("t")))
    explained = both.where("ord is not null").where(F.col("after") - F.col("before") <= most).select(key, "ord")
    return unknowns.join(explained, [key, "ord"], "left_anti")


def touching(rows: DataFrame, others: DataFrame, key: str, out: str = "touches") -> DataFrame:
    """``rows`` with whether any of ``others`` overlaps them in time (J4, J5): both start before the other ends.

    Of the others that start before a row ends, the latest end decides, so one sort and a running maximum do; no pairs are made.
    Null keys and times touch nothing."""
    names = rows.columns
    asks = rows.select(key, F.col("end_sec").alias("t"), F.lit(0).alias("kind"), F.struct(*[F.col(c) for c in names]).alias("row"), F.lit(None).cast("double").alias("end"))
    marks = others.where(F.col("start_sec").isNotNull() & F.col(key).isNotNull()).select(key, F.col("start_sec").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(asks.schema["row"].dataType).alias("row"), F.col("end_sec").cast("double").alias("end"))
    reach = F.max("end").over(Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = asks.unionByName(marks).withColumn("reach", reach).where("kind = 0")
    return swept.select("row.*", F.coalesce(F.col("t").isNotNull() & (F.col("reach") > F.col("row.start_sec")), F.lit(False)).alias(out))


def refine_ends(tracks: DataFrame, durations: DataFrame, key: str, sources: tuple[str, ...] | None = None) -> DataFrame:
    """Tracks named by a list (of one of ``sources``, else by column ``listed``) end where the next track starts, or the recording
    does, if that is later than their start (H12)."""
    w = Window.partitionBy(key).orderBy("start_sec", "ord")
    rows = tracks.join(durations, key).withColumn("next", F.coalesce(F.lead("start_sec").over(w), F.col("duration")))
    named = F.col("listed") if sources is None else F.col("source").isin(*sources)
    end = F.when(named & (F.col("next") > F.col("start_sec")), F.col("next")).otherwise(F.col("end_sec"))
    return rows.withColumn("end_sec", end).drop("next", "duration")


def longest_unknowns(unknowns: DataFrame, key: str, most: int = 20, *order: str) -> DataFrame:
    """Add ``retry``: whether the unknown is among the ``most`` longest of its recording, first of equals (I3) by ``order``, else ``ord``."""
    w = Window.partitionBy(key).orderBy((F.col("start_sec") - F.col("end_sec")), *(order or ("ord",)))
    return unknowns.withColumn("retry", F.row_number().over(w) <= most)


def deep_scan_gate(pools: DataFrame, unknowns: DataFrame, key: str, enabled: bool = True) -> DataFrame:
    """Whether a recording is worth the slow pass (C4): over half of its segments, or three, unknown."""
    n = pools.groupBy(key).agg(F.count(F.lit(1)).alias("known")).join(unknowns.groupBy(key).agg(F.count(F.lit(1)).alias("unknown")), key, "full")
    known, unknown = F.coalesce("known", F.lit(0)), F.coalesce("unknown", F.lit(0))
    return n.select(key, known.alias("known"), unknown.alias("unknown"), (F.lit(enabled) & ((unknown / (known + unknown) > 0.5) | (unknown >= 3))).alias("deep_scan"))

"""A stored inverted index of fingerprint hashes (inventory J9, H4, I2): band values to track and place, so that a search reads what may match.

Three hashes in a row are a word of 96 bits, in four bands of 24. Of an alignment at a floor ``f`` at most ``D = (1 - f) * 32 * q`` bits differ, so
among its query's ``W`` words some band differs in at most ``r = D // 4W`` bits, and at least ``4W - D // (r + 1)`` do. A search looks up all values within
``r`` bits of its words' bands, counts votes for each offset between track and query, and scores the offsets with enough of them exactly:
no alignment at the floor is missed, and chance ones rarely get enough votes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.operators.similarity import top_matches
from cuewright.sources.tables import Tables

WORD, BANDS, BITS = 3, 4, 24
#: Key ranges and buckets of tracks, a file each, of a new index.
BUCKETS = 64
#: Bits within which bands are looked up at most, and looked-up values that go to every task; queries beyond the first are scanned for,
#: and more values than the second are shuffled.
MOST_BITS, BROADCAST = 2, 2_000_000
EARLY = 0.97


def _band_keys(hashes: np.ndarray) -> np.ndarray:
    """[word, band]: band number and value of the words that start at each hash."""
    if len(hashes) < WORD:
        return np.empty((0, BANDS), np.int64)
    a, b, c = (hashes[i : len(hashes) - WORD + 1 + i].astype(np.int64) for i in range(WORD))
    low = (1 << BITS) - 1
    values = (a & low, (a >> BITS) | ((b & 0xFFFF) << 8), (b >> 16) | ((c & 0xFF) << 16), c >> 8)
    return np.stack([value | (k << BITS) for k, value in enumerate(values)], 1)


def _near(bits: int) -> np.ndarray:
    """All patterns of at most so many bits."""
    return np.array([sum(1 << i for i in chosen) for n in range(bits + 1) for chosen in combinations(range(BITS), n)], np.int64)


def build_index(library: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``library`` (track_id, hashes: 32-bit numbers) at ``path``: ``bands`` by key range, ``tracks`` by bucket, and
    the number of these.

    Null hashes count as empty. Four rows a hash, which a task makes track by track."""

    def run(batches):
        for batch in batches:
            for track, hashes in zip(batch.column("track_id").to_pylist(), batch.column("hashes"), strict=True):
                keys = _band_keys(np.array(hashes.values.to_numpy(zero_copy_only=False) if hashes.is_valid else [], np.int64))
                place = np.repeat(np.arange(len(keys), dtype=np.int32), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), pa.array(np.full(keys.size, track, np.int64)), pa.array(place)], names=["key", "track_id", "place"])

    rows = library.select("track_id", "hashes")
    span = (BANDS << BITS) // buckets
    bands = rows.mapInArrow(run, "key int, track_id long, place int").withColumn("bucket", F.floor(F.col("key") / span).cast("int"))
    bands.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/bands")
    rows.withColumn("bucket", F.pmod("track_id", F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/tracks")
    library.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def _lookups(asks: DataFrame, floor: float) -> DataFrame:
    """(query_id, pitch_ord, word, needed, key): the band values to look up for each variant, and the votes that an offset needs."""

    def run(batches):
        for batch in batches:
            for query, pitch, hashes in zip(batch.column("query_id").to_pylist(), batch.column("pitch_ord").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                keys = _band_keys(np.array(hashes, np.int64))[::WORD]
                differ, bands = int((1 - floor) * 32 * len(hashes) + 1e-9), keys.size
                bits = differ // bands
                tried = (keys.ravel()[:, None] ^ _near(bits)[None, :]).ravel()
                word = np.repeat(np.arange(len(keys), dtype=np.int32) * WORD, tried.size // len(keys))
                fixed = lambda x, kind: pa.array(np.full(len(tried), x, kind))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([fixed(query, np.int64), fixed(pitch, np.int32), pa.array(word), fixed(bands - differ // (bits + 1), np.int32), pa.array(tried.astype(np.int32))], names=["query_id", "pitch_ord", "word", "needed", "key"])

    return asks.mapInArrow(run, "query_id long, pitch_ord int, word int, needed int, key int")


def indexed_matches(queries: DataFrame, spark: SparkSession, path: str, k: int, floor: float) -> DataFrame:
    """(query_id, rank, track_id, score, offset) as ``similarity.top_matches`` of the same queries and library, from the index at ``path``.

    Only files whose key range holds a looked-up value, and of tracks only buckets that hold a candidate, are read. Queries too short for the
    floor's lookups (their bands would differ in over ``MOST_BITS`` bits) are scanned for.
    """
    tables = Tables(spark, "lookups")
    rows = queries.select("query_id", F.col("pitch_ord").cast("int").alias("pitch_ord"), F.coalesce("hashes", F.array().cast("array<long>")).cast("array<long>").alias("hashes"))
    bands = F.floor(F.size("hashes") / WORD) * BANDS
    differ = F.floor((1 - floor) * 32 * F.size("hashes") + 1e-9)
    sure = F.coalesce((bands > 0) & (differ < (MOST_BITS + 1) * bands), F.lit(False))
    # all variants of a query go one way, since the best of them counts
    short = rows.where(~sure & (F.size("hashes") > 0)).select("query_id").distinct()
    rows = tables.write(rows.join(short.withColumn("scanned", F.lit(True)), "query_id", "left").where(F.size("hashes") > 0), "queries")
    asks = rows.where("scanned is null").drop("scanned")
    lookups = tables.write(_lookups(asks, floor), "lookups")
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    span = (BANDS << BITS) // buckets
    touched = [r[0] for r in lookups.select(F.floor(F.col("key") / span).cast("int")).distinct().collect()]  # as many as the index has
    index = spark.read.parquet(f"{path}/bands").where(F.col("bucket").isin(touched)).drop("bucket")
    side = F.broadcast(lookups) if lookups.count() <= BROADCAST else lookups
    votes = index.join(side, "key").groupBy("query_id", "pitch_ord", "track_id", (F.col("place") - F.col("word")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"), F.first("needed").alias("needed"))
    found = tables.write(votes.where("votes >= needed and offset >= 0").select("query_id", "pitch_ord", "track_id", "offset"), "found")
    held = [r[0] for r in found.select(F.pmod("track_id", F.lit(buckets)).cast("int")).distinct().collect()]
    tracks = spark.read.parquet(f"{path}/tracks")
    pairs = found.join(tracks.where(F.col("bucket").isin(held)).drop("bucket").withColumnRenamed("hashes", "own"), "track_id").join(asks, ["query_id", "pitch_ord"])
    size = F.size("hashes")
    bits = F.aggregate(F.zip_with(F.slice("own", F.col("offset") + 1, size), "hashes", lambda a, b: F.bit_count(a.cast("long").bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    scored = pairs.where(F.col("offset") + size <= F.size("own")).select("query_id", "pitch_ord", "track_id", "offset", (1 - bits / (32 * size)).alias("score")).where(F.col("score") >= floor)
    hit = F.struct("score", "offset")
    early = F.min_by(F.when(F.col("score") > EARLY, hit), F.when(F.col("score") > EARLY, F.col("offset")))
    one = scored.groupBy("query_id", "pitch_ord", "track_id").agg(F.coalesce(early, F.max_by(hit, F.struct("score", -F.col("offset")))).alias("h"))
    best = one.groupBy("query_id", "track_id").agg(F.max_by("h", F.struct("h.score", -F.col("pitch_ord"))).alias("h")).select("query_id", "track_id", "h.score", F.col("h.offset").cast("int").alias("offset"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "track_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "track_id", "score", "offset")
    if not short.isEmpty():
        ranked = ranked.unionByName(top_matches(rows.where("scanned").drop("scanned"), tracks.drop("bucket"), k, floor))
    results = Tables(spark, "matches")
    done = results.write(ranked, "rows")
    tables.drop()
    return done

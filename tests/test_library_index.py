"""The library table and the fingerprint index: equal to a plain upsert and to the scan, and reading only what may match."""

import os
import random

import numpy as np
import pytest
from cuewright.operators import hash_index, similarity
from cuewright.sources import library_table
from pyspark.sql import functions as F

ROWS = "id long, filepath string, title string"


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_batches_touch_their_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/lib"
    first = spark.createDataFrame([(i, f"/m/{i}.mp3", "old") for i in range(200)] + [(900, None, "x"), (901, " ", "x")], ROWS)
    assert library_table.upsert_library(first, path) == (200, 200)
    before = stamps(path)
    batch = spark.createDataFrame([(1, "/m/1.mp3", "seen"), (2, "/m/new.mp3", "a"), (3, "/m/new.mp3", "b")], ROWS)
    assert library_table.upsert_library(batch, path) == (2, 201)
    after = stamps(path)
    assert all(after[f] == t for f, t in before.items()) and len(after) == len(before) + 1
    titles = {r["filepath"]: r["title"] for r in library_table.read_library(spark, path).collect()}
    assert titles["/m/1.mp3"] == "old" and titles["/m/new.mp3"] == "b"
    assert library_table.upsert_library(batch, path) == (0, 201) and stamps(path) == after
    # replaced rows rewrite their buckets, no others
    assert library_table.upsert_library(batch, path, replace=True) == (3, 201)
    changed = stamps(path)
    assert sum(changed.get(f) == t for f, t in after.items()) >= len(before) - 2
    assert {r["title"] for r in library_table.read_library(spark, path).where("filepath = '/m/1.mp3'").collect()} == {"seen"}
    assert library_table.upsert_library(first, path, limit=5) == (0, 201)
    assert library_table.upsert_library(first, f"{tmp_path}/few", limit=5)[1] == 5
    assert library_table.upsert_library(first.limit(3), path, rebuild=True)[1] == 3


@pytest.mark.parametrize("seed", range(3))
def test_random_batches_equal_a_dictionary(spark, tmp_path, seed):
    rng, path, want = random.Random(seed), f"{tmp_path}/lib", {}
    for step in range(3):
        rows = [(step * 100 + i, f"/m/{rng.randrange(40)}", f"{step}-{i}") for i in range(30)]
        replace = step == 2
        library_table.upsert_library(spark.createDataFrame(rows, ROWS), path, replace=replace, buckets=8)
        seen = set(want)
        want |= {p: t for _, p, t in rows if replace or p not in seen}
    assert {r["filepath"]: r["title"] for r in library_table.read_library(spark, path).collect()} == want


def flipped(rng, hashes, bits):
    out = hashes.copy()
    for at in rng.choice(len(out) * 32, bits, replace=False):
        out[at // 32] ^= np.uint32(1 << (at % 32))
    return out


@pytest.mark.parametrize("floor", [0.9, 0.97])
def test_index_equals_scan(spark, tmp_path, floor):
    rng = np.random.default_rng(int(floor * 100))
    tracks = [rng.integers(0, 1 << 32, rng.integers(0, 120), dtype=np.uint32) for _ in range(120)]
    tracks[5] = np.tile(tracks[7][:6], 12)  # repeats itself: many alignments alike
    asks = []
    for q in range(12):
        own = tracks[rng.integers(0, 120)]
        n = int(rng.integers(20, 40))
        if len(own) > n:
            at = int(rng.integers(0, len(own) - n))
            near = int((1 - floor) * 32 * n)
            for pitch, bits in enumerate((near + 40, max(0, near - int(rng.integers(0, 9))), near)):
                asks.append((q, pitch, flipped(rng, own[at : at + n], bits).astype(np.int64).tolist()))
    asks += [(50, 0, tracks[5][:30].astype(np.int64).tolist()), (51, 0, [1, 2]), (52, 0, []), (53, 0, None), (54, 0, tracks[9][:4].astype(np.int64).tolist())]
    library = spark.createDataFrame([(i, t.astype(np.int64).tolist()) for i, t in enumerate(tracks)] + [(500, None)], "track_id long, hashes array<long>")
    queries = spark.createDataFrame(asks, "query_id long, pitch_ord int, hashes array<long>")
    path = f"{tmp_path}/index"
    hash_index.build_index(library, path)
    found = sorted(map(tuple, hash_index.indexed_matches(queries, spark, path, 3, floor).collect()))
    assert found == sorted(map(tuple, similarity.top_matches(queries, library, 3, floor).collect())) and len(found) > 8


def test_index_reads_what_may_match(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    path, seen = f"{tmp_path}/index", []
    tracks = [rng.integers(0, 1 << 32, 60, dtype=np.uint32) for _ in range(400)]
    hash_index.build_index(spark.createDataFrame([(i, t.astype(np.int64).tolist()) for i, t in enumerate(tracks)], "track_id long, hashes array<long>"), path, 256)
    keys = hash_index._band_keys(tracks[3][:24])[:: hash_index.WORD].ravel()
    touched = {int(k) // ((hash_index.BANDS << hash_index.BITS) // 256) for k in keys}
    bands = spark.read.parquet(f"{path}/bands")
    read = bands.where(F.col("bucket").isin(sorted(touched))).where(F.col("key").isin([int(k) for k in keys]))
    assert len(touched) <= 32 and "PartitionFilters: [bucket" in read._jdf.queryExecution().toString() and read.count() < bands.count() / 50
    asks = spark.createDataFrame([(1, 0, tracks[3][:24].astype(np.int64).tolist())], "query_id long, pitch_ord int, hashes array<long>")
    assert [tuple(r) for r in hash_index.indexed_matches(asks, spark, path, 3, 0.97).collect()] == [(1, 1, 3, 1.0, 0)]


def test_blocks_of_queries_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    tracks = [(i, rng.integers(0, 1 << 32, 40).tolist()) for i in range(30)]
    library = spark.createDataFrame(tracks, "track_id long, hashes array<long>")
    queries = spark.createDataFrame([(q, 0, tracks[q][1][5:20]) for q in range(8)], "query_id long, pitch_ord int, hashes array<long>")
    words = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} x") for i in range(20)], "id long, text string")
    run = lambda: (sorted(map(tuple, similarity.top_matches(queries, library, 2, 0.4).collect())), sorted(map(tuple, similarity.token_overlap(words, words.withColumnRenamed("id", "item").withColumnRenamed("text", "t"), "id", "text", "item", "t", 3).collect())))
    whole = run()
    monkeypatch.setattr(similarity, "BLOCK", 64)
    assert run() == whole and len(whole[0]) == 16 and len(whole[1]) == 60

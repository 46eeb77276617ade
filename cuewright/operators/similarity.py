"""Searches of small query sets against a whole library: sliding Hamming similarity of hashes (inventory H4, H5, J9, I2) and shared
words (J12). Queries go to all tasks in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cuewright.functions.text import word_set
from cuewright.sources.tables import Tables

#: Hashes of queries in one broadcast (4 bytes each); more go in further passes over the library.
BLOCK = 4 << 20
#: Hashes of tracks that are compared at once, few enough for a processor's cache.
_CELLS = 1 << 15
#: Alignments of queries with tracks that a sieve takes at once.
_ALIGNED = 1 << 17
#: Alignments are compared one by one when one in two to the power of this is left at most.
_SPARSE = 3
#: Neighbouring bits that must be equal in all hashes for a sieve to pay off.
_RUN = 4


def best_alignment(query: np.ndarray, library: np.ndarray, early: float = 0.97) -> tuple[float, int]:
    """(share of equal bits, offset): the first alignment over ``early``, else the first best; (0, 0) if none fits."""
    q, n = len(query), len(library)
    if not q or not n or q > n:
        return 0.0, 0
    frames = np.lib.stride_tricks.sliding_window_view(library, q)
    scores = 1 - np.bitwise_count(frames ^ query).sum(1, dtype=np.int64) / (32 * q)
    over = np.nonzero(scores > early)[0]
    at = int(over[0]) if len(over) else int(scores.argmax())
    return float(scores[at]), at


def padded(column: pa.ListArray):
    """(rows, [row, place] hashes, lengths) of pieces of the column, rows of like length together."""
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.uint32), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        own = order[at : at + max(1, _CELLS // max(1, int(lengths[order[min(len(order) - 1, at + 4096)]])))]
        n = lengths[own]
        out = np.zeros((len(own), int(n.max())), np.uint32)
        inside = np.arange(out.shape[1]) < n[:, None]
        out[inside] = values[(offsets[own][:, None] + np.arange(out.shape[1]))[inside]]
        yield own, out, n
        at += len(own)


def turned(tracks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([place, row] hashes, and two neighbours in one number) of ``tracks`` [row, place]."""
    flat = np.ascontiguousarray(tracks.T)
    wide = flat.astype(np.uint64)
    return flat, wide[:-1] | (wide[1:] << np.uint64(32))


def differences(query: np.ndarray, flat: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """[offset, row]: bits in which the query differs from each stretch of the tracks, two hashes at a time."""
    q, offsets = len(query), len(flat) - len(query) + 1
    out = np.zeros((offsets, flat.shape[1]), np.uint16 if 32 * q < 1 << 16 else np.int32)
    bits, count = np.empty(out.shape, np.uint64), np.empty(out.shape, np.uint8)
    wide = query.astype(np.uint64)
    for j, value in enumerate((wide[:-1] | (wide[1:] << np.uint64(32)))[::2]):
        np.bitwise_xor(pairs[2 * j : 2 * j + offsets], value, out=bits)
        np.bitwise_count(bits, out=count)
        out += count
    if q % 2:
        out += np.bitwise_count(flat[q - 1 :] ^ query[-1])
    return out


def alignments(query: np.ndarray, tracks: np.ndarray, lengths: np.ndarray, early: float = 0.97) -> tuple[np.ndarray, np.ndarray]:
    """``best_alignment`` of one query with each row of ``tracks``."""
    return bounded_alignments(query, *turned(tracks), lengths, -1.0, early)


def bounded_alignments(query: np.ndarray, flat: np.ndarray, pairs: np.ndarray, lengths: np.ndarray, bound: float, early: float = 0.97) -> tuple[np.ndarray, np.ndarray]:
    """``alignments`` with ``turned`` tracks; tracks that can't score ``bound`` may score -1 instead."""
    q = len(query)
    score, at = np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
    if not q or len(flat) < q:
        return score, at
    differ = differences(query, flat, pairs)
    if int(lengths.min()) < len(flat):
        differ[np.arange(len(differ))[:, None] > lengths - q] = np.iinfo(differ.dtype).max
    fits = lengths >= q
    score[fits] = -1
    rows = np.nonzero(fits & (1 - differ.min(0) / (32 * q) >= bound))[0]
    scores = 1 - differ[:, rows] / (32 * q)
    over = scores > early
    at[rows] = np.where(over.any(0), over.argmax(0), scores.argmax(0))
    score[rows] = scores[at[rows], np.arange(len(rows))]
    return score, at


def turning_bits(hashes: np.ndarray) -> int:
    """The bits that differ from the next higher one in any of ``hashes``."""
    return int(np.bitwise_or.reduce(hashes ^ (hashes >> np.uint32(1)), axis=None, initial=0)) & 0x7FFFFFFF


def widest_run(turning: int) -> tuple[int, int]:
    """(lowest bit, width) of the widest run of bits that are equal in every hash, given ``turning_bits``."""
    best, start = (0, 1), 0
    for bit in range(32):
        if bit - start + 1 > best[1]:
            best = (start, bit - start + 1)
        if turning >> bit & 1:
            start = bit + 1
    return best


def sieve_words(hashes: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(signs, rests, hashes in a rest) at each place of ``hashes`` [place, ...]: the run's bit of this and the next 31 hashes, and the other
    bits of this and as many of the next as fit into 64 bits."""
    n, other = len(hashes), 32 - width
    per = 64 // other if other else n
    sign = hashes >> np.uint32(low) & np.uint32(1)
    rest = (hashes & np.uint32((1 << low) - 1) | (hashes >> np.uint32(low + width - 1) >> np.uint32(1)) << np.uint32(low)).astype(np.uint64)
    signs, rests = sign.copy(), rest.copy()
    for j in range(1, min(32, n)):
        signs[: n - j] |= sign[j:] << np.uint32(j)
    for j in range(1, min(per, n) if other else 1):
        rests[: n - j] |= rest[j:] << np.uint64(j * other)
    return signs, rests, per


def query_words(queries: np.ndarray, low: int, width: int) -> list[tuple[int, np.ndarray, np.generic, int]]:
    """(place, word of each query, mask, weight of a bit) by which ``sieved`` compares ``queries`` [query, place], the run's bits first."""
    q, ones = queries.shape[1], lambda n, kind: kind((1 << n) - 1)
    signs, rests, per = sieve_words(queries.T, low, width)
    words = [(p, signs[p], ones(min(32, q - p), np.uint32), width) for p in range(0, q, 32)]
    return words + [(p, rests[p], ones(min(per, q - p) * (32 - width), np.uint64), 1) for p in range(0, q, per) if width < 32]


def _counted(words, signs: np.ndarray, rests: np.ndarray, rows: int, who: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which alignments ``at`` of the queries ``who`` differ by ``words`` in as many bits as there is ``room`` for at most, and the room left."""
    for place, word, mask, weight in words:
        bits = (signs if word.dtype == np.uint32 else rests)[place * rows :][at] ^ word[who]
        count = np.bitwise_count(bits & mask if ~mask else bits)
        room = room - (count if weight == 1 else count * np.int32(weight))
        near = np.flatnonzero(room >= 0)
        who, at, room = who[near], at[near], room[near]
    return who, at, room


def sieved(q: int, words, signs: np.ndarray, rests: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, k: int, early: float = 0.97) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score, offset) of the tracks that score the query's own of ``bounds`` (over 0) or more, as ``best_alignment`` scores them, and
    of some that don't.

    ``words`` are those of queries of ``q`` hashes, ``signs`` and ``rests`` the tracks'. A bit that a run repeats counts by the run's width, so the first
    word leaves few alignments, and each further one fewer. With ``k``, tracks that can't be among a query's ``k`` best of these may be missing, too.
    """
    (places, rows), asked = signs.shape, len(bounds)
    if places < q:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))
    bits, size = 32 * q, (places - q + 1) * rows
    kind = np.uint16 if bits < (1 << 16) - 1 else np.int32
    limits = ((1 - np.minimum(bounds, early)) * bits).astype(np.int32) + 1
    differ, count = np.zeros((asked, size), kind), np.empty((asked, size), np.uint8)
    outs = np.empty((asked, size), np.uint32), np.empty((asked, size), np.uint64)
    signs, rests = signs.ravel(), rests.ravel()
    inside = lambda at: at // rows <= lengths[at % rows] - q
    for n, (place, word, mask, weight) in enumerate(words, 1):
        # while many alignments are left all are compared, then only those left
        own, out = (signs, outs[0]) if word.dtype == np.uint32 else (rests, outs[1])
        np.bitwise_xor(own[place * rows : place * rows + size], word[:, None], out=out)
        if ~mask:
            np.bitwise_and(out, mask, out=out)
        np.bitwise_count(out, out=count)
        differ += np.multiply(count, weight, dtype=kind) if weight > 1 else count
        if n == 1 and 0 < k <= rows:
            # the nearest by the first word alone show how near the k best are at least
            for i in range(asked):
                share = count[i, :: max(1, size >> 12)]
                few = min(len(share) - 1, 8)
                seeds = np.flatnonzero(count[i] <= np.partition(share, few)[few])
                seeds = seeds[inside(seeds)]
                _, seeds, room = _counted(words[1:], signs, rests, rows, np.full(len(seeds), i), seeds, bits - differ[i, seeds].astype(np.int32))
                nearest = np.full(rows, bits + 1, np.int32)
                np.minimum.at(nearest, seeds % rows, bits - room)
                limits[i] = min(limits[i], max(int(np.partition(nearest, k - 1)[k - 1]), int((1 - early) * bits) + 1))
        near = differ <= limits.astype(kind)[:, None]
        if np.count_nonzero(near) << _SPARSE <= near.size:
            break
    at = np.flatnonzero(near)
    who = at // size
    who, at, room = _counted(words[n:], signs, rests, rows, who, at - who * size, limits[who] - differ.ravel()[at])
    if int(lengths.min()) < places:
        fits = inside(at)
        who, at, room = who[fits], at[fits], room[fits]
    differ = limits[who] - room
    scores = 1 - differ / bits
    order = np.lexsort((at, np.where(scores > early, -1, differ), at % rows, who))
    own = order[np.unique((who * rows + at % rows)[order], return_index=True)[1]]
    return who[own], at[own] % rows, scores[own], at[own] // rows


def variant_scores(rows: DataFrame, variants: str, track: str, out: str) -> DataFrame:
    """``rows`` with each of ``variants`` (an array of hash arrays) scored against ``track`` (a hash array), as an array (H4)."""

    @F.pandas_udf("array<double>")
    def score(asked: pd.Series, own: pd.Series) -> pd.Series:
        hashes = lambda x: np.asarray(x, np.int64).astype(np.uint32)
        return pd.Series([[best_alignment(hashes(q), hashes(t))[0] for q in qs] for qs, t in zip(asked, own, strict=True)])

    return rows.withColumn(out, score(F.col(variants), F.col(track)))


def _one_pass(found: DataFrame, shared: Broadcast, tables: Tables, block: int, blocks: int) -> DataFrame:
    """What a block of queries finds. Where there are several, each is found at once and its queries are let go, so only one is held."""
    if blocks == 1:
        return found
    rows = tables.write(found, f"block-{block}")
    shared.destroy()
    return rows


def top_matches(queries: DataFrame, library: DataFrame, k: int, floor: float) -> DataFrame:
    """(query_id, rank, track_id, score, offset): each query's ``k`` most similar tracks at ``floor`` or more.

    ``queries``: query_id, pitch_ord, hashes (variants of one query: the best counts, first of equals); ``library``: track_id,
    hashes; hashes are arrays of unsigned 32-bit numbers. Ties go by track. The library is scanned, never shuffled;
    a task passes on ``k`` rows a query. Null hashes count as empty.
    """
    spark = queries.sparkSession
    schema = "query_id long, track_id long, score double, offset int"
    empty = F.array().cast("array<long>")
    asks = queries.select("query_id", "pitch_ord", F.coalesce("hashes", empty).alias("hashes"))
    total = asks.agg(F.coalesce(F.sum(F.size("hashes") + 8), F.lit(0)).alias("n")).head()["n"]
    blocks, tables = max(1, -(-total // BLOCK)), Tables(spark, "matches")
    found = spark.createDataFrame([], schema)
    rows = library.select("track_id", F.coalesce("hashes", empty).alias("hashes"))
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id", "pitch_ord").collect()
        variants: dict[int, list[np.ndarray]] = {}
        for r in own:
            variants.setdefault(r["query_id"], []).append(np.array(r["hashes"], np.int64).astype(np.uint32))
        shared = spark.sparkContext.broadcast(variants)

        def search(batches, shared=shared):
            names, variants, seen = list(shared.value), list(shared.value.values()), 0
            top: list[list[tuple]] = [[] for _ in names]  # (score turned round, track, row of the task, variant, offset)
            bounds = np.full(len(names), floor, float)  # what the task's best leave room for
            groups: dict[int, list[tuple[int, int]]] = {}  # queries' variants of a length
            for i, own in enumerate(variants):
                for v, h in enumerate(own):
                    groups.setdefault(len(h), []).append((i, v))
            asked = {q: (np.array([i for i, _ in own]), np.array([v for _, v in own]), np.stack([variants[i][v] for i, v in own])) for q, own in groups.items() if q}
            turning, run, words = int(np.bitwise_or.reduce([turning_bits(h) for _, _, h in asked.values()] or [0])), None, {}

            def keep(i: int, new: list[tuple]) -> None:
                held = {}
                for entry in sorted(top[i] + new):
                    held.setdefault(entry[2], entry)  # of a row the best variant, of equals the first
                top[i] = list(held.values())[:k]
                if len(top[i]) == k:
                    bounds[i] = max(floor, -top[i][-1][0])

            for batch in batches:
                ids = batch.column("track_id").to_numpy(zero_copy_only=False)
                widest = widest_run(turning | turning_bits(batch.column("hashes").flatten().to_numpy(zero_copy_only=False).astype(np.uint32)))
                through_sieve = floor > 0 and widest[1] >= _RUN
                if through_sieve and run != widest:
                    run, words = widest, {q: query_words(h, *widest) for q, (_, _, h) in asked.items()}
                for which, tracks, lengths in padded(batch.column("hashes")):
                    if through_sieve:
                        signs, rests, _ = sieve_words(np.ascontiguousarray(tracks.T), *run)
                        for q, (owner, variant, _) in asked.items():
                            step = max(1, _ALIGNED // max(1, (signs.shape[0] - q + 1) * len(which)))
                            for lo in range(0, len(owner), step):
                                own = owner[lo : lo + step]
                                fresh = min(len(top[i]) for i in own.tolist()) < k
                                who, row, score, at = sieved(q, [(p, w[lo : lo + step], *more) for p, w, *more in words[q]], signs, rests, lengths, bounds[own], k if fresh else 0)
                                hit = np.flatnonzero(score >= bounds[own][who])
                                new: dict[int, list[tuple]] = {}
                                for x, r, y, z in zip(who[hit].tolist(), row[hit].tolist(), score[hit].tolist(), at[hit].tolist(), strict=True):
                                    new.setdefault(int(own[x]), []).append((-y, int(ids[which[r]]), seen + int(which[r]), int(variant[lo + x]), z))
                                for i, entries in new.items():
                                    keep(i, entries)
                    else:
                        flat, pairs = turned(tracks)
                        for i, wanted in enumerate(variants):
                            best, at = np.full(len(which), -1.0), np.zeros(len(which), np.int64)
                            for hashes in wanted:
                                score, place = bounded_alignments(hashes, flat, pairs, lengths, bounds[i])
                                better = score > best
                                best, at = np.where(better, score, best), np.where(better, place, at)
                            hit = np.nonzero(best >= bounds[i])[0]
                            if len(hit):
                                hit = hit[np.lexsort((ids[which[hit]], -best[hit]))[:k]]
                                keep(i, list(zip((-best[hit]).tolist(), ids[which[hit]].tolist(), (seen + which[hit]).tolist(), [0] * len(hit), at[hit].tolist(), strict=True)))
                seen += batch.num_rows
            out = [(query, track, -score, at) for query, own in zip(names, top, strict=True) for score, track, _, _, at in own]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["query_id", "track_id", "score", "offset"])

        found = found.unionByName(_one_pass(rows.mapInArrow(search, schema), shared, tables, b, blocks))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "track_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "track_id", "score", "offset")


def token_overlap(queries: DataFrame, items: DataFrame, query_id: str, query_text: str, item_id: str, item_text: str, k: int) -> DataFrame:
    """The ``k`` items that share most of a query's words (J12, M4, I5): shared words over the query's, ties by item. Items that share
    none have no row. The items are scanned, never shuffled; a task passes on ``k`` rows a query."""
    spark = queries.sparkSession
    id_type, item_type = (f.schema[c].dataType.simpleString() for f, c in ((queries, query_id), (items, item_id)))
    schema = f"`{query_id}` {id_type}, `{item_id}` {item_type}, score double"
    asks = queries.select(F.col(query_id).alias("id"), word_set(query_text).alias("w")).where(F.size("w") > 0)
    total = asks.agg(F.coalesce(F.sum(F.size("w") + 1), F.lit(0)).alias("n")).head()["n"]
    blocks, tables = max(1, -(-total // (BLOCK // 8))), Tables(spark, "overlap")
    rows = items.select(F.col(item_id).alias("id"), word_set(item_text).alias("w"))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        words = sorted({w for r in own for w in r["w"]})
        number = {w: i for i, w in enumerate(words)}
        pairs = np.array(sorted((number[w], q) for q, r in enumerate(own) for w in r["w"]), np.int64).reshape(-1, 2)
        # the queries that hold each word, one word after the other
        shared = spark.sparkContext.broadcast((words, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1], np.array([len(r["w"]) for r in own]), [r["id"] for r in own]))

        def search(batches, shared=shared):
            words, starts, holders, sizes, ids = shared.value
            vocabulary, top = pa.array(words, pa.string()), {}
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    lists = part.column("w")
                    item = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                    word = pa.compute.fill_null(pa.compute.index_in(lists.flatten(), vocabulary), -1).to_numpy()
                    item, word = item[word >= 0], word[word >= 0]
                    n = starts[word + 1] - starts[word]
                    query = holders[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[word], n)]
                    keys, counts = np.unique(query * 512 + np.repeat(item, n), return_counts=True)
                    score = counts / sizes[keys // 512]
                    names = part.column("id").to_pylist()
                    cuts = np.searchsorted(keys // 512, np.arange(len(ids) + 1)).tolist()
                    for q in np.unique(keys // 512).tolist():
                        own = slice(cuts[q], cuts[q + 1])
                        new = [(-s, names[i]) for s, i in zip(score[own].tolist(), (keys[own] % 512).tolist(), strict=True)]
                        top[q] = sorted(top.get(q, []) + new)[:k]
            out = [(ids[q], i, -s) for q, own in top.items() for s, i in own]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[query_id, item_id, "score"])

        types = [to_arrow_type(f.dataType) for f in found.schema.fields]
        found = found.unionByName(_one_pass(rows.mapInArrow(search, schema), shared, tables, b, blocks))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), item_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "rank", item_id, "score")

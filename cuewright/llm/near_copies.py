"""Near copies by SimHash and vantage-point trees, then by exact similarity of word shingles.

Fingerprints within three bits are linked by vantage-point trees first, as in ``simhash_vp``. Texts that these links leave apart are
linked as well if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Of such two, the first
n - ceil(0.8 n) + 1 shingles of each, in any one order of all shingles, share one (prefix filter), so texts that share none of these
are never compared and none is missed. The first shingle in that order that two texts share also says how many they share at most: what
is left of each from there on. Shingles that are common in a sample come last in the order, which only saves
comparisons. Two more bounds, from the sizes and from counts of shingles by bin, then rule most candidates out; whole sets decide about the
others. Large groups are first linked to a hub; then only texts that the links leave apart are paired with the rest of their group, if the
parities of their sets, compared in the join, allow it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm import tokens
from cuewright.llm.common import join_hot, materialise, scratch, tidy
from cuewright.llm.simhash_vp import components, fold, near_links, shingle_hashes

WORDS = 5
#: Similarity NUM / DEN or more links.
NUM, DEN = 4, 5
#: Documents that are sampled to find common shingles (one in ``SHARE`` at least, so that how common a shingle must be doesn't grow with the
#: table), the number of them in the sample from which a shingle is common, and shingles sent to every task. They decide the order alone.
SAMPLE, SHARE, COMMON, MOST_COMMON = 10_000, 8, 4, 1 << 18
#: Groups up to so many texts compare all pairs at once; larger ones start with a hub.
SMALL = 16
#: Shingles of a text that tell at its later ones whether a pair has met before, and what says that it hasn't. So a pair is made once, at the
#: first shingle that both have; only one that first meets behind these is made again at each further one.
MET = 64
_UNMET = "not arrays_overlap(l.before, r.before)"
#: Shingles in a bin, about. The counts of bins, a byte each, bound what two sets share. A set with a fuller bin has no bound.
IN_BIN = 8
#: Longs of a set's parities, by which pairs of large groups are ruled out before they are made.
PARITIES = 8
_CHUNK = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, words: int = WORDS):
    """Per text the sorted distinct 64-bit hashes of its shingles. Fewer words: one shingle; none: the shingle 0. A-Z count as
    lower case, and only ASCII white space separates."""
    for _, part in tokens.batches_of(column, _CHUNK):
        data, offsets = tokens.column_bytes(part)
        starts, ends = tokens.space_tokens(data, offsets)
        h = tokens.run_hashes(tokens.lower(data), starts, ends)
        cuts = np.searchsorted(starts, offsets)
        whole = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            whole = _step(whole, h[k : k + len(whole)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            else:
                short = np.full(1, b - a, np.uint64) if b > a else np.zeros(1, np.uint64)
                for k in range(a, b):
                    short = _step(short, h[k : k + 1])
                yield short


def _step(sums: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = (sums ^ h) * _MIX
    return out ^ (out >> np.uint64(31))


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which texts this similar share one: the rarest, equals by hash."""
    keys, ranks = common
    n = len(shingles)
    if len(keys):
        slot = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        rank = np.where(keys[slot] == shingles, ranks[slot], 0)
        shingles = shingles[np.argsort(rank, kind="stable")]
    return shingles[: n - -(-n * NUM // DEN) + 1]


def bins_of(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall in each bin, by their first bits, a byte each; null if one holds too many. The number of bins is a power
    of two that grows with the set."""
    bits = max(4, (len(shingles) // IN_BIN).bit_length())
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def parities_of(shingles: np.ndarray) -> np.ndarray:
    """Whether each of ``PARITIES`` longs' bits is hit by an odd number of shingles. Sets differ in at least as many shingles as their
    parities do in bits."""
    hit = np.bincount((shingles & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(hit.astype(np.uint8)).view(np.uint64)


def most_shared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """What each pair of sets shares at most: of each bin the smaller count. The finer bins of one are added up to those of the other."""
    out = np.empty(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0).tolist():
        own = np.nonzero((sizes == (m, n)).all(1))[0]
        x, y = (np.frombuffer(b"".join(side[k] for k in own.tolist()), np.uint8).reshape(len(own), min(m, n), -1).sum(2, dtype=np.int32) for side in (a, b))
        out[own] = np.minimum(x, y).sum(1)
    return out


def similar_sets(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared * (NUM + DEN) >= (len(a) + len(b)) * NUM


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.empty(0, np.uint64)]).view(np.int64)))


def _whole(batches):
    for batch in batches:
        for _, part in tokens.batches_of(batch.column("text"), _CHUNK):
            yield pa.RecordBatch.from_arrays([_lists(list(shingle_sets(part)))], names=["shingles"])


def _prefixes(common):
    def run(batches):
        for batch in batches:
            for at, part in tokens.batches_of(batch.column("text"), _CHUNK):
                found = list(shingle_sets(part))
                digests = [np.array([np.bitwise_xor.reduce(s), np.sum(_step(s, s >> np.uint64(7)))], np.uint64).tobytes() for s in found]
                prints = np.array([fold(shingle_hashes(t or b"")) for t in part.cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)), batch.column("rid").slice(at, len(part)), pa.array(prints.view(np.int64)), pa.array([len(s) for s in found], pa.int32()), pa.array(digests, pa.binary()),
                     pa.array([bins_of(s) for s in found], pa.binary()), _lists([parities_of(s) for s in found]), _lists([prefix(s, common.value) for s in found])], names=["id", "rid", "fp", "n", "digest", "bins", "parities", "prefix"],
                )

    return run


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, ranks from 1, the commoner the later) of shingles that are common in a sample of (rid, text)."""
    share = max(1, min(SHARE, docs.count() // SAMPLE))
    sample = docs.where(F.pmod(F.xxhash64("rid"), F.lit(share)) == 0).select("text").mapInArrow(_whole, "shingles array<long>")
    counts = sample.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "s").limit(MOST_COMMON).toPandas()
    keys = top["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def _within_bounds(batches):
    """Pairs whose bins allow the similarity: two sets share no more than the smaller count of each bin, in all."""
    for batch in batches:
        na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in ("na", "nb"))
        keep = np.minimum(na, nb) * DEN >= np.maximum(na, nb) * NUM
        known = keep & np.asarray(batch.column("bins_a").is_valid()) & np.asarray(batch.column("bins_b").is_valid())
        at = np.nonzero(known)[0]
        if len(at):
            keep[at] = most_shared(*(batch.column(k).take(pa.array(at)).to_pylist() for k in ("bins_a", "bins_b"))) * (NUM + DEN) >= (na + nb)[at] * NUM
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in ("a", "b")], names=["a", "b"])


def _verify(batches):
    """The pairs (a, b) of texts that are similar enough."""
    held: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        a, keep = batch.column("a").to_pylist(), []
        for k, other in enumerate(shingle_sets(batch.column("text_b"))):
            if a[k] != held[0]:
                held = a[k], next(shingle_sets(batch.column("text_a").slice(k, 1)))
            keep.append(similar_sets(held[1], other))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in ("a", "b")], names=["a", "b"])


def similar(pairs: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough, of ``firsts`` (rid, n, bins) and ``docs`` (rid, text)."""
    side = lambda x: firsts.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins_{x}"))
    near = materialise(pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_within_bounds, "a long, b long"), "near-bounded")
    texts = lambda x: docs.join(near.select(F.col(x).alias("rid")).distinct(), "rid", "left_semi").select(F.col("rid").alias(x), F.col("text").alias(f"text_{x}"))
    both = near.join(texts("b"), "b").join(texts("a"), "a").select("a", "b", "text_a", "text_b")
    return materialise(both.mapInArrow(_verify, "a long, b long"), "near-links")


def _pairs(left: DataFrame, right: DataFrame, apart: str) -> DataFrame:
    """Pairs a < b of a row of ``left`` and one of ``right`` (s, i, rid, n, ...) with the same shingle, from whose places on enough is left of
    both to allow the similarity. The first shingle that two similar texts share passes."""
    enough = f"least(l.n - l.i, r.n - r.i) * {NUM + DEN} >= (l.n + r.n) * {NUM}"
    both = left.alias("l").join(right.alias("r"), F.expr(f"l.s = r.s and {enough} and {apart}"))
    return both.select(F.least("l.rid", "r.rid").alias("a"), F.greatest("l.rid", "r.rid").alias("b"))


def outside_pairs(labelled: DataFrame, firsts: DataFrame) -> DataFrame:
    """``_pairs`` of rows of ``labelled`` (s, i, rid, n, before, label) with different labels, of groups (s) that hold some. One row of each pair
    lies outside its group's largest label, and parities (of ``firsts``) allow the similarity: no more than a ninth of both sets differs."""
    top = labelled.groupBy("s", "label").count().groupBy("s").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    placed = labelled.join(top, "s").join(firsts.select("rid", "parities"), "rid").withColumn("outside", F.expr("label <> top")).drop("top", "labels")
    differ = " + ".join(f"bit_count(l.parities[{k}] ^ r.parities[{k}])" for k in range(PARITIES))
    apart = f"l.label <> r.label and (not l.outside or l.rid < r.rid) and ({differ}) * {NUM + DEN} <= (l.n + r.n) * {DEN - NUM} and {_UNMET}"
    return _pairs(placed, placed.where("outside"), apart)


def with_met(members: DataFrame) -> DataFrame:
    """``members`` (s, i, rid, ...) with ``before``: the first shingles, up to ``MET``, that the text has among them at smaller places."""
    of_one = Window.partitionBy("rid").orderBy("i")
    placed = members.withColumn("nth", F.row_number().over(of_one))
    early = F.collect_list(F.when(F.col("nth") <= MET, F.col("s")))
    return placed.withColumn("before", early.over(of_one.rowsBetween(Window.unboundedPreceding, -1))).drop("nth")


def print_links(rows: DataFrame, same: DataFrame) -> DataFrame:
    """(a, b): the first text of each set in ``same`` (n, digest, first) with the first of all that its fingerprints reach in ``rows``
    (n, digest, fp) over links of three bits."""
    sets = materialise(rows.select("n", "digest", "fp").distinct().join(same.select("n", "digest", F.col("first.rid").alias("b")), ["n", "digest"]).select("fp", "b"), "near-prints")
    reach = components(near_links(sets.select("fp").distinct())).withColumnRenamed("node", "fp")
    grouped = sets.join(reach, "fp", "left").select("b", F.coalesce("label", "fp").alias("label"))
    hubs = grouped.groupBy("label").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialise(join_hot(grouped, hubs, "label", "size", sets.count()).where("a <> b").select("a", "b").distinct(), "near-print-links")


def near_groups(docs: DataFrame) -> DataFrame:
    """(rid, best) per row of ``docs`` (id, rid, text): the first row, as a struct (no_id, id, rid), that links reach."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    rows = materialise(docs.mapInArrow(_prefixes(common), "id long, rid long, fp long, n int, digest binary, bins binary, parities array<long>, prefix array<long>"), "near-prefixes")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid"))
    same = materialise(rows.groupBy("n", "digest").agg(first.alias("first"), F.count(F.lit(1)).alias("size")), "near-same")  # equal sets, by count and 128 bits
    firsts = materialise(rows.join(same.select(F.col("first.rid").alias("rid")), "rid", "left_semi"), "near-firsts")
    printed = print_links(rows, same)
    named = firsts.join(components(printed), F.col("rid") == F.col("node"), "left").select("rid", "n", F.coalesce("label", "rid").alias("part"), "prefix")
    # texts by prefix shingle with its place in each text; of shingles that the same texts have, the first, which is so in all of them
    of_one = Window.partitionBy("s")
    shared = named.select("rid", "n", "part", F.posexplode("prefix").alias("i", "s")).withColumns({"size": F.count(F.lit(1)).over(of_one), "hub": F.min("rid").over(of_one), "hub_part": F.min_by("part", "rid").over(of_one)}).where("size > 1")
    shared = materialise(shared, "near-shared")
    tidy(docs.sparkSession)
    groups = shared.groupBy("s").agg(F.first("size").alias("size"), F.first("hub").alias("hub"), F.min_by("i", "rid").alias("i"), F.bit_xor(F.xxhash64("rid")).alias("texts")).groupBy("size", "hub", "texts").agg(F.min_by("s", "i").alias("s"))
    members = materialise(with_met(shared.join(groups.select("s"), "s", "left_semi")), "near-members")
    small, large = members.where(F.col("size") <= SMALL), members.where(F.col("size") > SMALL)
    started = _pairs(small, small, f"l.rid < r.rid and l.part <> r.part and {_UNMET}").union(large.where("part <> hub_part").select(F.col("hub").alias("a"), F.col("rid").alias("b")))
    links = printed.union(similar(started, firsts, docs))
    if not large.isEmpty():
        # pairs in one component need no link; every other pair of a group has one text outside its largest component
        label = components(links)
        labelled = large.select("s", "i", "rid", "n", "before").join(label, F.col("rid") == F.col("node"), "left").select("s", "i", "rid", "n", "before", F.coalesce("label", "rid").alias("label"))
        labelled = materialise(labelled, "near-labelled")
        links = links.union(similar(outside_pairs(labelled, firsts), firsts, docs))
    label = components(links)
    roots = same.join(label, F.col("first.rid") == F.col("node"), "left").select("n", "digest", "size", "first", F.coalesce("label", "first.rid").alias("label"))
    best = roots.groupBy("label").agg(F.min("first").alias("best"))
    key = F.struct("n", "digest").alias("key")
    return join_hot(rows.select("id", "rid", key), roots.join(best, "label").select(key, "size", "best"), "key", "size", rows.count()).select("id", "rid", "best")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest identifier of each group of near copies (null identifiers last), with the input's own
    columns. Null and empty texts are near copies of each other. An empty table gives no rows."""
    with scratch(docs.sparkSession):
        landed = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "near-landed", keep=True)
        flat = landed.select(F.col(f"row.`{id_col}`").cast("long").alias("id"), "rid", F.col(f"row.`{text_col}`").alias("text"))
        keep = materialise(near_groups(flat).where("rid = best.rid").select("rid"), "near-keep", keep=True)
    return landed.join(keep, "rid", "left_semi").select("row.*")

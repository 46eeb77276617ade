"""SimHash near-duplicates by vantage-point trees.

Fingerprints are partitioned by their Hamming distance from vantage points, which a bounded sample of them gives: the
leaves of this top tree are the shards. A fingerprint lives in one shard and visits every other shard whose boundary is within
the radius, so the triangle inequality guarantees that each linked pair meets. Inside a shard a local vantage-point tree
prunes branches by the same bounds. A shard gives a spanning forest of its links, never all pairs of a dense group, and the
forests are joined by min-label propagation over tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import join_hot, materialise, scratch

RADIUS, WORDS, SEED = 3, 3, 42
#: Distinct fingerprints on the driver at most, to choose vantage points.
SAMPLE = 20_000
#: Fingerprints that a shard should hold, and visits that one task of a shard should take. The sample makes no more than ``MAX_SHARDS``
#: shards; beyond that, a shard's fingerprints are dealt out to several tasks as well.
SHARD_ROWS, VISITS = 16_384, 100_000
MAX_SHARDS = 4_096
LEAF = 256


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; fewer words give one shingle, none gives none."""
    parts = text.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(parts) - words + 1)
    last = (ends[words - 1 :] if len(parts) >= words else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)


_ONES = np.uint64(0x0101010101010101)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros((8, 8), np.int64)  # [bit in byte, byte]
    cuts = np.arange(0, n, 255)  # byte-wide counters hold 255 rows
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _ONES, cuts)
        counts[bit] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = (counts * 2 > n).T.reshape(-1)  # byte by byte, low bits first
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, rid_col: str | None = None) -> DataFrame:
    """(id, rid, fp): the SimHash of every whole text; null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fold(shingle_hashes(t or b"", words)) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), pa.array(fps.view(np.int64))], names=["id", "rid", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, rid long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(points: np.ndarray) -> tuple[int, np.ndarray, int]:
    """Of a few points the one whose distances spread most, with the distances and their median."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(5, len(points))).astype(int)]:
        d = distance(points, v)
        if best is None or d.std() > best[1].std():
            best = v, d
    v, d = best
    return int(v), d, int(np.median(d))


def top_tree(points: np.ndarray, shards: int) -> tuple:
    """Nested (vantage, threshold, inside, outside) with shard numbers at the leaves, in order."""
    number = iter(range(1 << 30))

    def build(own: np.ndarray, want: int):
        if want > 1 and len(own) > 1:
            v, d, mid = _vantage(own)
            inside = d <= mid
            if 0 < inside.sum() < len(own):
                return v, mid, build(own[inside], want // 2), build(own[~inside], want - want // 2)
        return next(number)

    return build(points, shards)


def route(tree, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of the shard where each fingerprint lives and of later shards that it visits."""
    out: list[tuple] = []

    def walk(node, rows, home):
        if not len(rows):
            return
        if isinstance(node, int):
            out.append((rows, np.full(len(rows), node, np.int32), home))
            return
        v, mid, inside, outside = node
        d = distance(fps[rows], np.uint64(v)).astype(np.int64)
        here = home & (d <= mid)
        go = here | (~home & (d <= mid + radius)) | (home & (d > mid) & (d <= mid + radius))
        walk(inside, rows[go], here[go])
        here = home & (d > mid)
        go = here | (d > mid - radius)
        walk(outside, rows[go], here[go])

    walk(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
    rows, shard, home = (np.concatenate(x) for x in zip(*out, strict=True))
    lives = np.empty(len(fps), np.int32)
    lives[rows[home]] = shard[home]
    keep = shard >= lives[rows]  # a pair's other direction finds it as well
    return rows[keep], shard[keep], home[keep]


def linked(data: np.ndarray, queries: np.ndarray, radius: int):
    """(data index, query index) arrays of all pairs within the radius: a local vantage-point tree, all queries at once."""
    todo = [(np.arange(len(data)), np.arange(len(queries)))]
    while todo:
        own, asks = todo.pop()
        if not len(own) or not len(asks):
            continue
        if len(own) > LEAF:
            v, d, mid = _vantage(data[own])
            inside = d <= mid
            if 0 < inside.sum() < len(own):
                dq = distance(queries[asks], np.uint64(v)).astype(np.int64)
                todo.append((own[inside], asks[dq <= mid + radius]))
                todo.append((own[~inside], asks[dq > mid - radius]))
                continue
        step = max(1, (1 << 20) // len(own))
        for k in range(0, len(asks), step):
            part = asks[k : k + step]
            i, j = np.nonzero(distance(data[own][:, None], queries[part][None, :]) <= radius)
            if len(i):
                yield own[i], part[j]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node that the links reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_links(data: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, root) links, of all links between the shard's data and queries."""
    nodes = np.unique(np.concatenate((data, queries)))
    di, qi = np.searchsorted(nodes, data), np.searchsorted(nodes, queries)
    held_i, held_j, held = [], [], 0
    for i, j in linked(data, queries, radius):
        a, b = di[i], qi[j]
        own = a != b
        held_i.append(a[own])
        held_j.append(b[own])
        held += int(own.sum())
        if held > 1 << 22:
            label = forest(len(nodes), np.concatenate(held_i), np.concatenate(held_j))
            rest = np.nonzero(label != np.arange(len(nodes)))[0]
            held_i, held_j, held = [rest], [label[rest]], len(rest)
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    label = forest(len(nodes), np.concatenate(held_i), np.concatenate(held_j))
    rest = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[rest], nodes[label[rest]]


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``links`` (a, b). Labels spread through tables until none changes.
    Nodes with very many links are joined without a shuffle."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"), F.count(F.lit(1)).alias("links")).select("node", F.least("node", "label").alias("label"), "links"), "cc-labels")
    total, nodes = both.count(), labels.count()
    while True:
        heard = join_hot(both.select("a", F.col("b").alias("node")), labels, "node", "links", total).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        heard = materialise(labels.join(heard, "node").select("node", "links", F.col("label").alias("old"), F.least("label", "heard").alias("mid")), "cc-heard")
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("up")).join(heard.groupBy("mid").agg(F.count(F.lit(1)).alias("times")), "mid")
        labels = materialise(join_hot(heard, up, "mid", "times", nodes).select("node", F.least("mid", "up").alias("label"), "old", "links"), "cc-labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("old")


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) whose reach equals that of all pairs within ``radius``."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = max(1, min(MAX_SHARDS, -(-n // SHARD_ROWS)))
    share = max(1, -(-n // SAMPLE))
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").limit(2 * SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = top_tree(np.sort(sample), shards)

    def routed(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            rows, shard, home = route(tree, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[rows].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    visits = materialise(distinct.select("fp").mapInArrow(routed, "shard int, fp long, home boolean"), "vp-visits")
    # a shard's visits, and its fingerprints where there are too many, are dealt out: each part of the ones meets each part of the others
    parts = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("asks"), F.greatest(F.lit(1), F.ceil(F.count_if("home") / (2 * SHARD_ROWS))).cast("int").alias("holds"))
    dealt = visits.join(F.broadcast(parts), "shard")  # MAX_SHARDS rows at most
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    asks = dealt.select("shard", part("asks", 1).alias("ask"), upto("holds").alias("hold"), "fp", F.lit(False).alias("data"))
    data = dealt.where("home").select("shard", upto("asks").alias("ask"), part("holds", 2).alias("hold"), "fp", F.lit(True).alias("data"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, own = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["data"].to_numpy(bool)
        a, b = shard_links(np.sort(fps[own]), np.sort(fps[~own]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return materialise(asks.unionByName(data).groupBy("shard", "ask", "hold").applyInPandas(search, "a long, b long"), "vp-links")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, rid_col: str | None = None) -> DataFrame:
    """(id, rid, fp, component_id, keep_rid) per row of ``docs``.

    ``component_id`` is the smallest identifier reachable over links of at most ``radius`` bits (null identifiers last), and
    ``keep_rid`` its row, the first where rows repeat it. Null and empty texts have fingerprint 0 and link
    like any other. An empty table gives no rows; other columns of the input aren't read.
    """
    with scratch(docs.sparkSession):
        prints = materialise(fingerprints(docs, id_col, text_col, words, rid_col), "simhash", keep=True)
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid"))
        distinct = materialise(prints.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("rows")), "simhash-distinct")
        groups = components(near_links(distinct, radius))
        roots = distinct.join(groups, distinct["fp"] == groups["node"]).select("fp", "label", "first")
        best = roots.groupBy("label").agg(F.min("first").alias("best"))
        moved = roots.select("fp", "label").join(best, "label").select("fp", "best")
        by_print = materialise(distinct.join(moved, "fp", "left").select("fp", F.coalesce("best", "first").alias("best"), "rows"), "simhash-best", keep=True)
    return join_hot(prints, by_print, "fp", "rows", prints.count()).select("id", "rid", "fp", F.col("best.id").alias("component_id"), F.col("best.rid").alias("keep_rid"))


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return simhash_groups(docs, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest identifier of each group, with the input's own columns."""
    landed = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "simhash-landed")
    flat = landed.select(F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"), "rid")
    keep = simhash_groups(flat, "id", "text", rid_col="rid").where("rid = keep_rid").select("rid")
    return landed.join(keep, "rid", "left_semi").select("row.*")

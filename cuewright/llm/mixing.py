"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows from
patterns to source quotas; each further pass over a pattern costs more than the one before, so that the flow repeats as
little as it can. The flow of each pattern then becomes whole documents in a seeded order.
Only the patterns' sums reach the driver: their number depends on the sources, not on the documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import SPACE, materialise, scratch, text_or_empty

#: Seeded order: documents go by hash, then text and row, cut into levels of so many bits. A level finds the bucket in which a
#: pattern's border lies; the next only looks into that bucket, until it holds so few rows that one task may sort them.
BITS, SORTED = 14, 10_000
#: Membership patterns at most: the flow is found on the driver. Rows at patterns' borders that are sent to every task at most.
MOST_PATTERNS, BROADCAST_EDGE = 4_096, 1_000_000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACE}]+")).cast("long")


def source_targets(sizes: dict, weights=(3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> dict:
    """Exact targets: ``share`` of all sizes by weight (sources by code point, null last, weights repeating), none over
    ``most`` times its source's size; what exceeds goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), list(order), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * rate > most * sizes[s]]
        if not above:
            return target | {s: weight[s] * rate for s in free}
        for s in above:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in above]
    return target


def min_cost_flow(patterns: dict, targets: dict, most: int = 2) -> dict:
    """{(pattern, source): words}: the cheapest flow that meets as much of the targets as capacity allows.

    A pattern (tuple of sources) of n words supplies n words at each of the costs 0, 1, ... most - 1.
    Successive shortest paths with potentials over patterns + sources nodes.
    """
    supply = {p: [n] * most for p, n in patterns.items()}
    need = {s: round(t) for s, t in targets.items()}
    flow: dict = {}
    into: dict = {s: [] for s in targets}
    for p in patterns:
        for s in p:
            into[s].append(p)
    for cost in range(most):  # arcs between patterns and sources cost nothing, so paths go by the pass they start with
        while True:
            came: dict = {s: None for s in need if need[s] > 0}  # breadth first from sources in need, back over the flow
            queue, hit = sorted(came, key=lambda s: (s is None, s or "")), None
            while queue and hit is None:
                s = queue.pop(0)
                for p in into[s]:
                    if ("p", p) in came:
                        continue
                    came["p", p] = s
                    if supply[p][cost] > 0:
                        hit = p
                        break
                    for t in p:
                        if t not in came and flow.get((p, t), 0) > 0:
                            came[t] = p
                            queue.append(t)
            if hit is None:
                break
            path, p = [], hit
            while True:
                s = came["p", p]
                path.append((p, s))
                if (q := came[s]) is None:
                    break
                path.append((q, s, "back"))
                p = q
            end = path[-1][1]
            n = min([supply[hit][cost], need[end], *(flow[x[0], x[1]] for x in path if len(x) == 3)])
            for x in path:
                flow[x[0], x[1]] = flow.get((x[0], x[1]), 0) + (n if len(x) == 2 else -n)
            supply[hit][cost] -= n
            need[end] -= n
    return {k: n for k, n in flow.items() if n}


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: str | Column = "source", weights=(3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17) -> DataFrame:
    """One row per document: identifier, ``sources`` (array), ``size``, ``target`` and ``source_size`` of its
    first source, ``taken``: words the mix takes, a multiple of ``size`` and at most ``most`` times it.

    ``sources`` is a column of strings or of string arrays; a null source is a source of its own (the last). Empty
    texts have size 0 and are never taken; ties go by hash, then by text. The input's other columns aren't
    read, so their names can't clash. An empty table gives no rows. The same input and seed give the same mix (rows that
    share identifier and text may change places). Over ``MOST_PATTERNS`` different sets of sources are an error.
    """
    with scratch(docs.sparkSession):
        return _mix(docs, id_col, text_col, sources, weights, share, most, seed)


def _mix(docs: DataFrame, id_col: str, text_col: str, sources: str | Column, weights, share: Fraction, most: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.select(F.col(sources) if isinstance(sources, str) else sources).schema[0].dataType.typeName()
    source = F.col(sources) if isinstance(sources, str) else sources
    members = F.array_sort(F.array_distinct(F.when(F.size(source) > 0, source).otherwise(F.array(F.lit(None).cast("string"))))) if kind == "array" else F.array(source.cast("string"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    base = materialise(
        docs.select(
            F.col(id_col).alias("id"), members.alias("members"), word_count(text_col).alias("size"),
            F.conv(F.substring(key, 1, 12), 16, 10).cast("long").alias("u"), F.xxhash64(text_col).alias("t"), F.monotonically_increasing_id().alias("rid"),
        ),
        "mix-sizes", keep=True,
    )
    found = base.groupBy("members").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"documents have over {MOST_PATTERNS} different sets of sources; mix by fewer or coarser sources")
    patterns = {tuple(r["members"]): r["n"] for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = source_targets(sizes, weights, share, most)
    flow = min_cost_flow(patterns, targets, most)
    plan = []
    for p, n in patterns.items():
        f = sum(flow.get((p, s), 0) for s in p)
        passes, rest = divmod(f, n) if n else (0, 0)
        plan.append((list(p), passes, rest, sizes[p[0]], float(targets[p[0]])))
    plan_df = F.broadcast(spark.createDataFrame(plan, "members array<string>, passes long, rest long, source_size long, target double"))
    key_of = lambda c: F.to_json(F.struct(F.transform(c, lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("n"))).alias("m")))
    planned = base.withColumn("pattern", key_of("members")).join(plan_df.select(key_of("members").alias("pattern"), "passes", "rest", "source_size", "target"), "pattern")
    return _select(planned).select(
        F.col("id").alias(id_col), F.col("members").alias("sources"), "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("extra"))).cast("long").alias("taken")
    )


def _levels() -> list[Column]:
    """The seeded order as numbers of ``BITS`` bits, the most telling first: 48 bits of hash, 64 of text, 64 of row."""
    out = []
    for column, bits in (("u", 48), ("t", 64), ("rid", 64)):
        for shift in range(bits - BITS, -BITS, -BITS):
            value = F.shiftrightunsigned(column, shift) if shift > 0 else F.col(column)
            out.append(value.bitwiseAND(F.lit((1 << (BITS if shift > 0 else BITS + shift)) - 1)))
    return out


def _select(planned: DataFrame) -> DataFrame:
    """Add ``extra``: 1 for the documents, in seeded order, whose sizes make up ``rest`` of their pattern."""
    levels = _levels()
    rows = planned.withColumn("place", F.array(*levels))
    inside, border, depth = rows.where("rest > 0"), None, 0
    while depth < len(levels):  # nearly always one or two levels
        own = inside if border is None else inside.join(F.broadcast(border), "pattern").where(F.slice("place", 1, depth) == F.col("upto_here"))
        own = own.withColumn("start", F.lit(0).cast("long") if border is None else F.col("start"))
        sums = own.groupBy("pattern", "rest", "start", F.get("place", F.lit(depth)).alias("bucket")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.first(F.slice("place", 1, depth + 1)).alias("upto_here"))
        ends = sums.withColumn("end", F.col("start") + F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")))  # 2 ** BITS rows a pattern at most
        at = ends.where("end > rest").groupBy("pattern").agg(F.min_by(F.struct("upto_here", (F.col("end") - F.col("n")).alias("start"), "rows"), "bucket").alias("b"))
        border = materialise(at.select("pattern", "b.*"), "mix-border")  # a row a pattern
        depth += 1
        if border.where(F.col("rows") > SORTED).isEmpty():
            break
    border = materialise(border.drop("rows"), "mix-at", keep=True)
    edge = rows.join(F.broadcast(border), "pattern").where(F.slice("place", 1, depth) == F.col("upto_here"))
    edge = edge.withColumn("upto", F.col("start") + F.sum("size").over(Window.partitionBy("pattern").orderBy("u", "t", "rid").rowsBetween(Window.unboundedPreceding, 0)))
    edge = materialise(edge.where("upto <= rest").select("pattern", "rid", "upto"), "mix-edge", keep=True)
    full = border.join(edge.groupBy("pattern").agg(F.max("upto").alias("upto")), "pattern", "left").select("pattern", "upto_here", F.coalesce("upto", "start").alias("filled"))
    at_edge = edge.select("rid", F.lit(1).alias("at_edge"))  # SORTED rows a pattern at most
    at_edge = F.broadcast(at_edge) if edge.count() <= BROADCAST_EDGE else at_edge
    inside = rows.join(F.broadcast(full), "pattern", "left").join(at_edge, "rid", "left")
    # every row that isn't past the border's bucket: arrays go by their first numbers
    inside = inside.withColumn("in_prefix", (F.col("rest") > 0) & (F.col("upto_here").isNull() | (F.slice("place", 1, depth) < F.col("upto_here")) | F.col("at_edge").isNotNull()))
    gap = F.col("rest") - F.col("filled")
    # one more document closes the gap that whole documents leave: the one whose size is nearest to it
    last = (
        inside.where(~F.col("in_prefix") & (F.col("rest") > 0) & (F.abs(gap - F.col("size")) < gap))
        .groupBy("pattern")
        .agg(F.min(F.struct(F.abs(gap - F.col("size")), "u", "t", "rid")).alias("m"))
        .select(F.col("m.rid").alias("rid"), F.lit(1).alias("fits"))
    )
    return inside.join(F.broadcast(materialise(last, "mix-last", keep=True)), "rid", "left").withColumn("extra", (F.col("in_prefix") | F.col("fits").isNotNull()).cast("long"))

import itertools
import random
from fractions import Fraction

import pytest
from cuewright.llm import mixing as M
from pyspark.sql import functions as F


def test_targets():
    t = M.source_targets({"a": 100, "b": 100, "c": 100, None: 10})
    assert sum(t.values()) == Fraction(465) and all(t[s] <= 2 * n for s, n in {"a": 100, "b": 100, "c": 100, None: 10}.items())
    assert t[None] == 20 and t["a"] == 200 and t["c"] == 2 * t["b"]
    assert M.source_targets({}) == {}


def test_flow_is_cheapest():
    r = random.Random(0)
    for _ in range(60):
        patterns = {p: r.randrange(0, 4) for p in (("a",), ("b",), ("a", "b"))}
        targets = {"a": r.randrange(0, 7), "b": r.randrange(0, 7)}
        best = None
        for x in itertools.product(range(7), repeat=4):  # words a<-a, b<-b, a<-ab, b<-ab
            used = {("a",): x[0], ("b",): x[1], ("a", "b"): x[2] + x[3]}
            if any(used[p] > 2 * n for p, n in patterns.items()) or x[0] + x[2] > targets["a"] or x[1] + x[3] > targets["b"]:
                continue
            key = (-sum(x), sum(max(0, used[p] - n) for p, n in patterns.items()))
            best = key if best is None else min(best, key)
        flow = M.min_cost_flow(patterns, targets)
        used = {p: sum(n for (q, _), n in flow.items() if q == p) for p in patterns}
        assert (-sum(used.values()), sum(max(0, used[p] - n) for p, n in patterns.items())) == best
        assert all(n >= 0 for n in flow.values()) and all(used[p] <= 2 * n for p, n in patterns.items())


def _check(got, rows):
    by = {}
    for x in got:
        assert x.taken in (0, x.size, 2 * x.size)
        by.setdefault(tuple(x.sources), []).append(x)
    for own in by.values():
        size = sum(x.size for x in own)
        assert size == own[0].source_size
        # one document more or less at most
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own) / 2 + 1
    assert len(got) == len(rows)


def test_mix(spark):
    r = random.Random(1)
    rows = [(k, " ".join("w" * 3 for _ in range(r.randrange(0, 60))), r.choice(["s1", "s1", "s1", "s2", "ß", None])) for k in range(400)] + [(7, "a b", "s1"), (None, "c", "s2"), (500, None, "s2"), (501, "\t \x0b", "s3"), (502, "z " * 90_000, "big")]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, source string, size int")
    got = M.mix_sources(docs).collect()
    _check(got, rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = M.source_targets(sizes)
    assert all(x.target == float(want[x.sources[0]]) for x in got)
    again = M.mix_sources(docs.repartition(7, F.rand(3))).collect()
    key = lambda x: (str(x.doc_id), x.size, str(x.sources))
    pairs = [(a.taken, b.taken) for a, b in zip(sorted(got, key=key), sorted(again, key=key)) if a.doc_id is not None and a.doc_id != 7]
    assert all(a == b for a, b in pairs)
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_overlapping_sources(spark):
    rows = [(k, "a b c d", ["x", "y"] if k % 3 == 0 else ["x"] if k % 3 == 1 else None) for k in range(300)]
    got = M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), share=Fraction(1)).collect()
    # a document of two sources counts in both sizes: the targets add up to 1600
    assert len(got) == 300 and abs(sum(x.taken for x in got) - 1600) <= 8 and all(x.taken <= 8 for x in got)


def test_many_sets_of_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "a b", [f"s{k % 7}", f"s{k % 5}"]) for k in range(200)], "doc_id long, text string, tags array<string>")
    monkeypatch.setattr(M, "BROADCAST_EDGE", 0)
    assert M.mix_sources(docs, sources="tags").count() == 200
    monkeypatch.setattr(M, "MOST_PATTERNS", 10)
    with pytest.raises(ValueError, match="different sets"):
        M.mix_sources(docs, sources="tags")

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from cuewright.llm import near_copies as N
from cuewright.llm.simhash_vp import fold, shingle_hashes


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def brute_kept(rows):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, j in combinations(range(len(rows)), 2):
        if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    return sorted(map(min, groups.values()))


def _rows():
    r = random.Random(3)
    words = lambda n: [f"wort{r.randrange(500)}" for _ in range(n)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "two one"), (5, "a b c d")]
    base, passage = words(120), words(60)
    for k in range(6, 160):
        if k % 4 == 0:  # a large group, some just inside and some outside of the bound
            own = list(base)
            for _ in range(r.randrange(6)):
                own[r.randrange(len(own))] = r.choice(["x", "y", "z"])
        elif k % 4 == 1:
            own = passage + words(r.randrange(5, 30))
        elif k % 4 == 2 and k > 40:
            own = rows[r.randrange(20, k)][1].split(" ")
            for _ in range(r.randrange(1, 3)):
                own[r.randrange(len(own))] = r.choice("pq")
        else:
            own = words(r.randrange(1, 150))
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize("small, common", [(16, 4), (2, 10**6)])
def test_equals_brute_force(spark, monkeypatch, small, common):
    for name, value in (("SMALL", small), ("COMMON", common)):
        monkeypatch.setattr(N, name, value)
    rows = _rows()
    want = brute_kept(rows)
    got = N.drop_near_copies(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n int").repartition(3))
    assert got.columns == ["doc_id", "text", "n"] and sorted(x.doc_id for x in got.collect()) == want and 20 < len(want) < 140


def test_stage_drops_copies_beyond_three_bits(spark):
    r = random.Random(8)
    text = [f"w{r.randrange(900)}" for _ in range(200)]
    copy = list(text)
    for k in (20, 90, 150):
        copy[k] = "other"
    assert 0.8 <= len(shingles(" ".join(text)) & shingles(" ".join(copy))) / len(shingles(" ".join(text)) | shingles(" ".join(copy))) < 0.9
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(copy)), (3, "something else")], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
    assert N.drop_near_copies(docs.limit(0)).count() == 0


def test_stage_links_fingerprints_within_three_bits(spark):
    """Refrains outweigh the rest in the fingerprint: two bits apart at most, though few distinct shingles are shared."""
    r = random.Random(4)
    refrain = " ".join(f"r{k}" for k in range(13))
    texts = [" ".join([refrain] * 400 + [f"{name}{k}" for k in range(40)]) for name in "xy"]
    a, b = map(shingles, texts)
    assert len(a & b) / len(a | b) < 0.3 and bin(fold(shingle_hashes(texts[0].encode())) ^ fold(shingle_hashes(texts[1].encode()))).count("1") <= 3
    other = " ".join(f"w{r.randrange(900)}" for _ in range(80))
    docs = spark.createDataFrame([(4, texts[0]), (2, texts[1]), (7, other)], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [2, 7]


def test_bins_bound_what_sets_share():
    r = np.random.default_rng(2)
    for n in (1, 30, 3000):
        a = np.unique(r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: n // 2], r.integers(0, 1 << 63, n, np.uint64))))
        bins = [N.bins_of(x) for x in (a, b)]
        shared = N.most_shared(bins, bins[::-1])
        assert (shared >= len(np.intersect1d(a, b))).all() and sum(bins[0]) == len(a) and (n < 30 or shared[0] < len(a))
    assert N.bins_of(np.arange(300, dtype=np.uint64)) is None


def test_places_leave_enough(spark):
    """Of texts that share a shingle, only those with enough left behind it in both are compared: 8 of 9 for equal sizes."""
    rows = spark.createDataFrame([(7, i, k, 90) for k, i in enumerate((0, 5, 10, 11, 17))] + [(8, 0, 9, 90), (8, 0, 10, 110), (8, 0, 11, 120)], "s long, i int, rid long, n int")
    got = {(r.a, r.b) for r in N._pairs(rows, rows, "l.rid < r.rid").collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (9, 10), (10, 11)}


@pytest.mark.parametrize("met", [64, 1])
def test_pairs_meet_once(spark, monkeypatch, met):
    """Texts that share many shingles are a pair at the first of them; behind the first ``MET``, pairs only come again."""
    monkeypatch.setattr(N, "MET", met)
    own = {1: (5, 6, 7, 8), 2: (5, 6, 8, 9), 3: (6, 7, 8), 4: (9,)}
    rows = spark.createDataFrame([(s, i, rid, 90) for rid, all_of in own.items() for i, s in enumerate(all_of)], "s long, i int, rid long, n int")
    members = N.with_met(rows)
    made = [(r.a, r.b) for r in N._pairs(members, members, f"l.rid < r.rid and {N._UNMET}").collect()]
    assert set(made) == {(1, 2), (1, 3), (2, 3), (2, 4)} and (len(made) == 4 if met == 64 else len(made) < 9)


def test_parities_rule_out_unlike_pairs_of_a_large_group(spark):
    r = np.random.default_rng(8)
    draw = lambda n: np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
    shared = draw(60)
    sets = []
    for _ in range(40):  # a passage that all share, and a rest that a near copy changes a little
        rest = draw(140)
        sets += [np.union1d(shared, rest), np.union1d(shared, np.concatenate((rest[:128], draw(12))))]
    alike = {(a, b) for a in range(80) for b in range(a + 1, 80) if N.similar_sets(sets[a], sets[b])}
    labelled = spark.createDataFrame([(1, 0, k, len(s), [], k) for k, s in enumerate(sets)], "s long, i int, rid long, n int, before array<long>, label long")
    firsts = spark.createDataFrame([(k, N.parities_of(s).view(np.int64).tolist()) for k, s in enumerate(sets)], "rid long, parities array<long>")
    made = [tuple(x) for x in N.outside_pairs(labelled, firsts).collect()]
    assert len(alike) == 40 and alike <= set(made)
    assert len(made) == len(set(made)) < 400  # of 3 160
    one = labelled.withColumn("label", labelled["rid"] * 0)
    assert N.outside_pairs(one, firsts).isEmpty()

import random
import re

import numpy as np
import xxhash
from cuewright.llm import simhash_vp as S


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i], changed = label[j], True
    return {(rows[i][0], f"{prints[i]:016x}", min(rows[k][0] for k in range(len(rows)) if label[k] == label[i])) for i in range(len(rows))}


def test_report_equals_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)] + ["Éa", "ÀB", "x y"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One TWO"), (5, "a b c"), (6, "a\x0bb\x0cc")]
    for k in range(7, 140):
        if k % 3 and k > 20:
            words = rows[r.randrange(7, k)][1].split(" ")
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.randrange(1, 400))]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, fp string")
    got = {tuple(x) for x in S.simhash_report(docs).collect()}
    assert got == brute_groups(rows)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {x[2] for x in got}


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_report(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d")] * 3 + [(None, "a b c d")], "doc_id long, text string")
    assert [tuple(x)[2] for x in S.simhash_report(twice).collect()] == [1] * 4
    assert S.drop_near_duplicates(twice).count() == 1


def test_shards_find_every_link():
    g = np.random.default_rng(3)
    base = g.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.uint64(1) << g.integers(0, 64, (3000, 3)).astype(np.uint64)
    points = np.unique(np.concatenate((base, g.choice(base, 3000) ^ np.bitwise_xor.reduce(flips, axis=1))))
    tree = S.top_tree(points, 8)
    rows, shard, home = S.route(tree, points, 3)
    a, b = [], []
    for k in range(8):
        own = points[rows[(shard == k) & home]]
        x, y = S.shard_links(np.sort(own), np.sort(points[rows[shard == k]]), 3)
        a.append(x), b.append(y)
    got = S.forest(len(points), np.searchsorted(points, np.concatenate(a)), np.searchsorted(points, np.concatenate(b)))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    assert (got == S.forest(len(points), i, j)).all()
    assert home.sum() == len(points)

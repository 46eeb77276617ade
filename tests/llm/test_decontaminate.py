import random

import numpy as np
from cuewright.llm import decontaminate as D


def brute(docs, items):
    out = set()
    for i, text in docs:
        words = D.words_of(text)
        for item, t in items:
            own = D.words_of(t)
            if not own or not words:
                continue
            goal, k = D.shingles_of(own), min(5, len(own))
            n = min(len(own), len(words))
            best = max((D.similarity(D.shingles_of(words[p : p + n], k), goal), -p) for p in range(len(words) - n + 1))
            if best[0] >= 0.8:
                out.add((i, item, round(best[0], 9), -best[1]))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"wort{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(6, 50)))) for k in range(25)] + [(90, "zwei wörter"), (91, ""), (92, None), (93, "!?"), (94, "a b a b a b a b a b")]
    docs = [(0, None), (1, ""), (2, "Zwei, Wörter"), (3, items[0][1].upper()), (4, "a b a b a b a b a b a b")]
    for k in range(5, 80):
        words = [r.choice(vocabulary + ["other", "neu"]) for _ in range(r.randrange(1, 150))]
        if k % 2:
            leak = r.choice(items[:25])[1].split()
            for _ in range(r.randrange(3)):
                leak[r.randrange(len(leak))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = leak[: r.randrange(len(leak) - 2, len(leak) + 1)]
        docs.append((k, " ".join(words)))
    rows = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(rows, bench)
    got = {(x[0], x[1], round(x[2], 9), x[3]) for x in found.collect()}
    assert got == brute(docs, items)
    kept = D.drop_leaks(rows, bench)
    assert kept.columns == rows.columns
    assert {x.doc_id for x in kept.collect()} == {d[0] for d in docs} - {g[0] for g in got}


def test_empty_tables_and_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two three four five six"), (2, "six seven"), (3, "one two three four five")], "item_id long, text string")
    assert D.find_leaks(none, bench).count() == 0
    assert D.find_leaks(rows, bench.limit(0)).count() == 0
    monkeypatch.setattr(D, "PART_BYTES", 20)
    assert sorted(map(tuple, D.find_leaks(rows, bench).collect())) == [(1, 1, 1.0, 1)] * 2 + [(1, 3, 1.0, 0)] * 2
    assert D.drop_leaks(rows, bench).count() == 0


def test_recall_on_edited_copies():
    """Copies near the border of 0.8 and above, of short and long items, against comparing every window."""
    r = random.Random(12)
    vocabulary = [f"wort{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([12, 20, 40, 80, 200, 500])))) for k in range(60)]
    docs = []
    for k in range(240):
        leak = items[k % 60][1].split()
        for _ in range(max(1, int(len(leak) * r.choice([0.005, 0.01, 0.02, 0.025])))):
            leak[r.randrange(len(leak))] = "changed"
        docs.append((k, " ".join([r.choice(vocabulary) for _ in range(r.randrange(30))] + leak + [r.choice(vocabulary) for _ in range(r.randrange(30))])))
    index = D.Index(items)
    want = {x[:2] for x in brute(docs, items)}
    got = {(i, h[0]) for i, t in docs for h in index.hits(t)}
    near = {x[:2] for x in brute(docs, items) if x[2] < 0.85}
    print("recall", len(got & want) / len(want), "of", len(want), "below 0.85:", len(got & near) / len(near), "of", len(near))
    assert got <= want and len(got & want) >= 0.9 * len(want) > 90 and len(got & near) >= 0.9 * len(near)


def test_the_multi_index_finds_all_within_the_radius():
    r = np.random.default_rng(1)
    index = D.Index([(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(300)])
    prints = np.concatenate((index.prints, r.integers(0, 256, (50, 8)).astype(np.uint8)))
    flips = np.zeros((len(prints), 64), np.uint8)
    for row, n in zip(flips, r.integers(0, 24, len(prints)), strict=True):
        row[r.permutation(64)[:n]] = 1
    prints ^= np.packbits(flips, axis=1)
    apart = np.bitwise_count(prints[:, None] ^ index.prints[None]).sum(2)
    assert set(zip(*(x.tolist() for x in index.near(prints)), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= D.RADIUS)), strict=True))

"""Spelling variants and their automata against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import automata, spelling

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(around[w]), form.get(w, ""), words.get(form.get(w), -1), root(w)) for w, n in words.items())


def texts(seed, n=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abÀé", k=rng.randint(6, 10))) for _ in range(8)]
    out = []
    for k in range(n):
        words = []
        for _ in range(40):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :]])
            words.append(rng.choice([w, w.upper(), w.title()]))
        out.append((k % 50, " ".join(words)))
    return out


@pytest.mark.parametrize("group,task", [(60_000, 60_000), (3, 10)])
def test_groups_equal_brute_force(spark, group, task):
    rows = [*texts(5), (None, "Abcdefgh abcdefgh,ABCDEFGH abcdefghi abcdefghi"), (7, None), (8, ""), (9, "x" * 5000 + " " + "x" * 5000 + "y " + "x" * 5000 + " " + "x" * 5000 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("q")).withColumn("id", F.lit(2))
    found = spelling.variant_groups(docs, group=group, task=task)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted((r[0], r[1], r[2], r[3] or "", -1 if r[4] is None else r[4], r[5]) for r in found.collect()) == brute(rows)


def test_forms_are_followed_to_the_end(spark):
    rows = [(None, " ".join(["zyxwvuts"] * 400 + ["zyxwvutsr"] * 40 + ["zyxwvutsrq"] * 4))]
    found = {r["word"]: r["root"] for r in spelling.variant_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {w: r for w, _, _, _, _, r in brute(rows)} and "zyxwvuts" in found.values()


def test_empty_table(spark):
    assert spelling.variant_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_automaton_numbers_and_one_error(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abc"[: 1 + seed % 3], k=rng.randint(1, 7))) for _ in range(rng.randint(1, 120))})
    auto = automata.build(words)
    # every word leads to its place in the list
    for k, w in enumerate(words):
        state, number = np.array([auto.start]), 0
        for c in w:
            there, at = auto.step(state, np.array([ord(c)]))
            assert there[0]
            state, number = auto.target[at], number + int(auto.skip[at[0]])
        assert auto.final[state[0]] and number == k
    # minimal: no two states have the same right language
    lang: dict[int, frozenset] = {}

    def right(s):
        if s not in lang:
            lang[s] = frozenset(([""] if auto.final[s] else []) + [chr(int(auto.keys[e]) & 0x1FFFFF) + t for e in range(auto.first[s], auto.first[s + 1]) for t in right(int(auto.target[e]))])
        return lang[s]

    right(auto.start)
    assert len(set(lang.values())) == len(lang) == len(auto.final)
    flat, off, length = automata.signs(words)
    for cut in (0, 1, 3):
        lo = np.minimum(cut, length)
        q, f = automata.within_one(auto, flat, off, length, lo, length)
        got = sorted((words[i], words[j]) for i, j in zip(q.tolist(), f.tolist(), strict=True))
        assert got == sorted((a, b) for a in words for b in words if near(a, b) and a[: min(cut, len(a))] == b[: min(cut, len(a))])

import hashlib
import random

import numpy as np
import pytest
from cuewright.llm import suffix_dedup as S
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 255), max_size=60), st.builds(lambda a, b: a * b, st.lists(st.integers(0, 3), max_size=6), st.integers(0, 9))))
def test_suffix_array(text):
    assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), [None] * len(rows)
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[k] = (rows[k][0], len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted(out, key=str)


def _rows(r):
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randrange(1, 9)))
    passages = ["".join(word() + " " for _ in range(r.randrange(20, 60))) for _ in range(8)] + ["x" * 300, "ab" * 200]
    rows = [(5, None), (4, ""), (7, "short"), (None, passages[0])]
    for k in range(10, 70):
        parts = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(passages)
            cut = r.randrange(len(p))
            parts.append(r.choice([p, p[cut:], p[:cut], "".join(word() for _ in range(30))]))
        rows.append((r.choice([k, 1000 - k, 33]), "".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "most", "spread"), [(1, 4096, 3), (2, 1, 2), (3, 4096, 0)])
def test_report_equals_brute_force(spark, monkeypatch, seed, most, spread):
    monkeypatch.setattr(S, "MOST_CONTEXTS", most)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 10**8 if spread else 0)
    rows = _rows(random.Random(seed))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, rid int")
    docs = docs.coalesce(1) if not spread else docs  # the order of repeated identifiers is the table's
    assert sorted(map(tuple, S.repeat_report(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert S.repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_not_shuffled_to_their_places(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame(_rows(random.Random(4)), "doc_id long, text string")
    plan = S.repeat_report(docs)._jdf.queryExecution().executedPlan().toString()
    joined = plan.split("ShuffledHashJoin")[1]
    assert joined.count("Exchange hashpartitioning(rid") == 1
    assert "Exchange" not in joined.split("Scan parquet")[0]  # above the texts
    assert "Bucketed: true" in joined

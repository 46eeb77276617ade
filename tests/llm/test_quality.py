import random
import zlib

import numpy as np
import pyarrow as pa
from cuewright.llm import quality as Q
from cuewright.llm import tokens


def test_tokens_of_columns():
    column = pa.array(["skip", "The  end!!", None, "", "é a", "x"]).slice(1)
    data, offsets = tokens.column_bytes(column)
    starts, ends = tokens.space_tokens(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["The", "end!!", "é", "a", "x"]
    assert np.searchsorted(starts, offsets).tolist() == [0, 2, 2, 2, 4, 5]
    s, e, k = tokens.sign_tokens(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["The", "end", "!!", "é", "a", "x"] and k.tolist() == [1, 1, 2, 1, 1, 1]
    twice, off = tokens.column_bytes(pa.array(["abc abd abc", "abc"]))
    h = tokens.run_hashes(twice, *tokens.space_tokens(twice, off))
    assert h[0] == h[2] == h[3] != h[1]
    assert [len(p) for _, p in tokens.batches_of(pa.array(["aaaa", "b", None, "cc"]), 4)] == [1, 3]


def _docs():
    r = random.Random(2)
    words = ["the", "sea", "is", "wide", "and", "cold", "today", "we", "sail"]
    rows, labels = [], []
    for k in range(500):
        good = k % 4 > 0
        text = " ".join(r.choice(words) + ("" if good else r.choice(["###", "!!", "$$"])) for _ in range(r.randrange(5, 60)))
        rows.append((k, text if good else text.upper(), "extra", 1.0))
        labels.append((k, int(good)))
    return rows + [(None, None, "x", None), (900, "", "x", None), (900, "", "x", None), (901, "sea " * 50_000, "x", None)], labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, x double")
    known = spark.createDataFrame([*labels, (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = Q.score_report(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    truth = dict(labels)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held) > 50
    kept = Q.keep_quality(docs, known)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if x.predicted}


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = _docs()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (sorted(Q.score_report(docs, spark.createDataFrame(x, "doc_id long, quality int")).select("doc_id", "score").toPandas()["score"]) for x in (labels, flipped))
    assert a == b


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score_report(none, labels).count() == 0
    assert [x.score for x in Q.score_report(docs, labels).collect()] == [0.5]


def test_labels_with_columns_of_any_name_and_a_bounded_sample(spark, monkeypatch):
    rows, labels = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, rid double")
    known = spark.createDataFrame([(i, q, 5, 7) for i, q in labels], "doc_id long, quality int, id int, rid int")
    assert Q.keep_quality(docs, known).columns == docs.columns
    monkeypatch.setattr(Q, "MAX_LABELLED", 60)
    seen = []
    monkeypatch.setattr(Q, "train", lambda x, y, real=Q.train: seen.append(len(y)) or real(x, y))
    assert Q.score_report(docs, known).count() == len(rows) and 30 <= seen[0] <= 90


def test_vectors_and_pooling_equal_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["sea", "Sea", "SEA", "wide!!", "and", "cold,"]) for _ in range(r.randrange(0, 25))) for _ in range(60)] + ["", None, "one"]
    per_text = [Q.buckets_of(*tokens.column_bytes(pa.array([t], pa.string())))[0].tolist() for t in texts]
    sums = np.zeros((Q.BUCKETS, Q.SIZE))
    for own in per_text:
        for i, b in enumerate(own):
            for j in range(max(0, i - Q.REACH), min(len(own), i + Q.REACH + 1)):
                if j != i:
                    for k in range(Q.NONZERO):
                        sums[b, Q._DIMS[own[j], k]] += Q._SIGNS[own[j], k]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    vectors = Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(vectors, want, atol=1e-5)
    for own, got in zip(per_text, Q.pooled(pa.array(texts, pa.string()), vectors), strict=True):
        v = want[own]
        near = [float(a @ b) for a, b in zip(v, v[1:])]
        same = [a == b for a, b in zip(own, own[1:])]
        mean = lambda x: sum(x) / max(1, len(own) - 1)
        slow = [*(v.mean(0) if own else np.zeros(Q.SIZE)), *(v.std(0) if own else np.zeros(Q.SIZE)), mean(near), mean(same), np.log1p(len(own)) / 5, not own]
        assert np.allclose(got, slow, atol=1e-3)

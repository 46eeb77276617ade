import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from cuewright.llm import lm_score as L
from cuewright.llm import tokens


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def _docs():
    r = random.Random(4)
    common = ["the", "house", "Stand", "and", "é", "sea,", "blue"]
    rows = [(k, " ".join(r.choice(common) if r.random() < 0.8 else f"w{r.randrange(200)}" for _ in range(r.randrange(1, 90)))) for k in range(150)]
    return rows + [(None, "the house"), (200, None), (201, ""), (202, " \x0b\t"), (203, "x" * 5000), (0, "the sea"), (204, "the blue " * 3000)]


@pytest.mark.parametrize("common", [0, 3, 10**6])
def test_base_score_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(L, "COMMON_WORDS", common)
    monkeypatch.setattr(L, "STEPS", 2)
    rows = _docs()
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        own = [*words(t), "\0end"]
        want.append((i, held(i), len(own), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    got = L.score_texts(spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, score string")).collect()
    key = lambda x: (str(x[0]), x[2], x[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5]) + 1e-9 and a[6] < 0


def test_empty_table(spark):
    assert L.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _model(seed=0):
    r = np.random.default_rng(seed)
    before = L.Before(r.integers(0, 9, L.CLASSES**2), np.log(r.dirichlet(np.ones(L.CLASSES))))
    return L.Attention({k: r.normal(0, 0.3, s) for k, s in L._SHAPES.items()}, before)


def test_gradients():
    m, r = _model(), np.random.default_rng(1)
    m.before.groups, m.before.members = m.before.groups.astype(np.float64), m.before.members.astype(np.float64)
    rows, want = r.integers(0, L.CLASSES, (2, L.WINDOW)), r.integers(0, L.CLASSES, 2 * L.WINDOW)
    keep, grads = {}, {}
    m.log_probs(m.states(rows, m.table(), keep).reshape(-1, L.STATE), rows.ravel(), want, grads)
    grads |= m.grads(rows, keep, grads.pop("h").reshape(2, L.WINDOW, L.STATE))
    assert set(grads) == set(m.p)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        values = []
        for step in (1e-5, -1e-5):
            m.p[k][at] += step
            values.append(-m.log_probs(m.states(rows, m.table()).reshape(-1, L.STATE), rows.ravel(), want).mean())
            m.p[k][at] -= step
        assert abs((values[0] - values[1]) / 2e-5 - g[at]) < 1e-3 * max(0.01, abs(g[at])), k


def test_causal_and_each_subword_once():
    m = _model()
    rows = np.random.default_rng(2).integers(0, L.CLASSES, (1, L.WINDOW))
    other = rows.copy()
    other[0, 20:] = (other[0, 20:] + 1) % L.CLASSES
    a, b = m.states(rows, m.table())[0], m.states(other, m.table())[0]
    assert np.allclose(a[:20], b[:20]) and not np.allclose(a[20:], b[20:])
    lengths = np.array([1, L.WINDOW - 1, L.WINDOW, L.WINDOW + 1, 112, 113, 500, 2])
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    for context in (0, L.CONTEXT):
        seen = np.zeros(offsets[-1], int)
        for _, start, filled, first in zip(*L.windows(offsets, context)):
            seen[start + first : start + filled] += 1
        assert (seen == 1).all()


def slow_score(m, own, end):
    """log10 probability of one text's classes, subword by subword, from the formulas alone."""
    p, total, step = m.p, 0.0, L.WINDOW - L.CONTEXT
    rows = [end, *own[:-1]]
    for i, target in enumerate(own):
        start = max(0, -(-(i + 1 - L.WINDOW) // step) * step)
        t = [p["e"][c].astype(float) @ p["t"] for c in rows[start : i + 1]]
        q = t[-1][: L.KEY]
        s = np.array([math.exp(q @ x[L.KEY : 2 * L.KEY] + p["r"][len(t) - 1 - k]) for k, x in enumerate(t)])
        h = np.maximum(0, t[-1][-L.STATE :] + (s / s.sum()) @ np.array([x[2 * L.KEY : 2 * L.KEY + L.STATE] for x in t]))
        g, k = divmod(int(target), L.MEMBERS)
        for logits, at in ((h @ p["w"] + m.before.groups[rows[i]], g), (h @ p["u"][g] + m.before.members[rows[i] * L.GROUPS + g], k)):
            total += (logits[at] - math.log(sum(map(math.exp, logits)))) / math.log(10)
    return total


def test_scores_equal_brute_force():
    m, r = _model(3), np.random.default_rng(4)
    m.p = {k: (x * 0.5).astype(np.float32) for k, x in m.p.items()}
    lengths = [1, 5, L.WINDOW, L.WINDOW + 1, 3 * L.WINDOW + 7, 200]
    texts = [np.append(r.integers(1, L.CLASSES, n - 1), 0).astype(np.int16) for n in lengths]
    for many in (1, 3, 256):
        got = L.score_classes(np.concatenate(texts), np.concatenate(([0], np.cumsum(lengths))), m, many)
        assert np.allclose(got, [slow_score(m, t, 0) for t in texts], rtol=1e-4)


def test_words_have_ids_of_their_own():
    subwords = L.Subwords(L.TOKENIZER)
    texts = ["one  two\u00a0x \u2003 é" + "!" * 500, "two one", None, "", "###$$ a" + "b" * 300 + " c"]
    for _ in range(2):
        ids, offsets = L.sequences(*L.words_of(*tokens.column_bytes(pa.array(texts))), subwords)
        for k, t in enumerate(texts):
            own = ids[offsets[k] : offsets[k + 1]]
            assert own[-1] == subwords.end and subwords.encoding.decode(own[:-1].tolist()) == "".join(" " + w for w in words(t))


def test_distribution_and_learning(monkeypatch):
    monkeypatch.setattr(L, "STEPS", 100)
    subwords = L.Subwords(L.TOKENIZER)
    text = ["the cat sat on the mat and the dog sat on the log " * 40] * 6
    ids, offsets = L.sequences(*L.words_of(*tokens.column_bytes(pa.array(text))), subwords)
    assert (np.diff(offsets) == offsets[1]).all() and ids[-1] == subwords.end
    counts = np.bincount(ids, minlength=subwords.size)
    classes = L.Classes(counts, subwords.end, subwords.starts)
    cls = classes.cls[ids].astype(np.int64)
    model = L.Attention.fresh(L.Before(np.bincount(np.roll(cls, 1) * L.CLASSES + cls, minlength=L.CLASSES**2), classes.bias))
    rows = np.roll(cls, 1)[None, : L.WINDOW]
    state, last = model.states(rows, model.table())[0, 5], rows[0, 5]
    p = np.exp(model.log_probs(np.tile(state, (L.CLASSES, 1)), np.full(L.CLASSES, last), np.arange(L.CLASSES)).astype(float))
    whole = p[classes.cls] * 10**classes.inside
    assert abs(whole.sum() - 1) < 1e-4 and (whole > 0).all()
    before = L.score_classes(cls, offsets, model)
    batch = pa.RecordBatch.from_arrays([pa.array([classes.cls[ids[a:b]].tobytes() for a, b in zip(offsets, offsets[1:])] * 60, pa.binary())], names=["classes"])
    for turn in range(L.ROUNDS):
        out = next(L._train(SimpleNamespace(value=model.flat()), SimpleNamespace(value=model.before), turn)(iter([batch])))
        model = L.Attention.of(np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in out.column("part")]), model.before)
    after = L.score_classes(cls, offsets, model)
    assert (after > 0.7 * before).all() and np.allclose(after, after[0], rtol=1e-4)


def test_every_window_is_trained_on_once(monkeypatch):
    subwords = L.Subwords(L.TOKENIZER)
    texts = [f"the cat sat on the mat and the dog sat on the log {k} " * 60 for k in range(200)] + ["", "one"]
    ids, offsets = L.sequences(*L.words_of(*tokens.column_bytes(pa.array(texts))), subwords)
    classes = L.Classes(np.bincount(ids, minlength=subwords.size), subwords.end, subwords.starts)
    cls, seen, weight = classes.cls[ids], 0, 0
    coded = [cls[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
    before = L.Before(np.zeros(L.CLASSES**2), classes.bias)
    trained = []
    monkeypatch.setattr(L.Attention, "train", lambda self, n, windows_of, seed: trained.append((n, windows_of)))
    for turn in range(L.ROUNDS):
        batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["classes"]) for part in (coded[:50], coded[50:])]
        out = next(L._train(SimpleNamespace(value=L.Attention.fresh(before).flat()), SimpleNamespace(value=before), turn)(iter(batches)))
        n, windows_of = trained[-1]
        x, y, ok = windows_of(np.arange(n))
        pairs = np.bincount(x.ravel()[ok] * L.CLASSES + y.ravel()[ok], minlength=L.CLASSES**2)
        seen, weight = seen + pairs, weight + out.column("weight")[0].as_py()
    assert weight == len(cls) and (seen == np.bincount(np.roll(cls, 1).astype(np.int64) * L.CLASSES + cls, minlength=L.CLASSES**2)).all()


def test_model_beats_its_base_on_held_out_texts(spark):
    got = L.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    base, score, n = got.selectExpr("sum(base_score)", "sum(score)", "sum(n_tokens)").head()
    print("log10 a token, held out: base", base / n, "model", score / n)
    assert score > base

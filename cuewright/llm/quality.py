"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Random indexing gives every hashed token a sparse random index vector and adds up, over all documents, the index vectors of its
neighbours: one matrix of fixed size, summed over tasks by blocks of rows. A document is the mean and the spread of its tokens' vectors.
Only the labelled sample's pooled vectors, at most ``MAX_LABELLED``, are learnt from on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import tokens
from cuewright.llm.common import crc_mod, materialise, scratch, sum_in_levels

#: Token buckets, vector length, non-zero entries of an index vector, neighbours on each side.
BUCKETS, SIZE, NONZERO, REACH = 8_192, 32, 2, 2
BLOCK = 64
#: Labelled documents learnt from, about, where there are more: chosen by hash.
MAX_LABELLED = 20_000
FEATURES = 2 * SIZE + 4
_R = np.random.default_rng(20240101)
#: Index vectors: each bucket's non-zero dimensions and signs.
_DIMS = _R.integers(0, SIZE, (BUCKETS, NONZERO))
_SIGNS = _R.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, token offsets of each text). Case makes part of a token, so does a run of signs."""
    starts, ends, kind = tokens.sign_tokens(data, offsets)
    h = tokens.run_hashes(tokens.lower(data), starts, ends)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    count = upper[ends] - upper[starts]
    shape = np.where(kind == 2, 3, np.where(count == 0, 0, np.where((count == ends - starts) & (count > 1), 2, 1)))
    # capitals and signs are rarer than words: a bucket for each word, but for capitals only few
    h = np.where(shape == 2, h % np.uint64(16), h) + (shape.astype(np.uint64) << np.uint64(40))
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(51)).astype(np.int64), np.searchsorted(starts, offsets)


def context_sums(bucket: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors of every bucket."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros(BUCKETS * SIZE)
    for step in range(1, REACH + 1):
        if len(bucket) <= step:
            break
        same = text[step:] == text[:-step]
        left, right = bucket[:-step][same], bucket[step:][same]
        for own, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                out += np.bincount(own * SIZE + _DIMS[other, k], _SIGNS[other, k], BUCKETS * SIZE)
    return out.reshape(BUCKETS, SIZE)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors of all buckets, learnt from all texts."""

    def partial(batches):
        total = np.zeros((BUCKETS, SIZE))
        for batch in batches:
            for _, part in tokens.batches_of(batch.column(0)):
                total += context_sums(*buckets_of(*tokens.column_bytes(part)))
        rows = total.astype(np.float32).reshape(-1, BLOCK * SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK * SIZE)
        for sums in pdf["sums"]:
            total += np.frombuffer(sums, np.float32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [total.astype(np.float32).tobytes()]})

    blocks = sum_in_levels(docs.select(text_col).mapInArrow(partial, "block int, sums binary"), add)
    found = {r["block"]: np.frombuffer(r["sums"], np.float32) for r in blocks.collect()}  # BUCKETS x SIZE floats, whatever the input
    empty = np.zeros(BLOCK * SIZE, np.float32)
    sums = np.concatenate([found.get(k, empty) for k in range(BUCKETS // BLOCK)]).reshape(BUCKETS, SIZE)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's token vectors, how near and how often equal neighbours are, log length, emptiness."""
    out = np.zeros((len(column), FEATURES), np.float32)
    for at, part in tokens.batches_of(column):
        bucket, offsets = buckets_of(*tokens.column_bytes(part))
        n = np.diff(offsets)
        own = out[at : at + len(n)]
        own[:, -2], own[:, -1] = np.log1p(n) / 5, n == 0
        full = np.nonzero(n)[0]
        if len(full):
            v = vectors[bucket]
            mean = np.add.reduceat(v, offsets[:-1][full], axis=0, dtype=np.float32) / n[full, None]
            square = np.add.reduceat(v * v, offsets[:-1][full], axis=0, dtype=np.float32) / n[full, None]
            own[full, :SIZE] = mean
            own[full, SIZE : 2 * SIZE] = np.sqrt(np.maximum(square - mean * mean, 0))
            near, same = np.zeros(len(bucket), np.float32), np.zeros(len(bucket), np.float32)
            near[:-1] = np.einsum("ij,ij->i", v[:-1], v[1:])
            same[:-1] = bucket[1:] == bucket[:-1]
            near[offsets[1:][full] - 1] = same[offsets[1:][full] - 1] = 0  # the next token is another text's
            for k, sums in ((2 * SIZE, near), (2 * SIZE + 1, same)):
                own[full, k] = np.add.reduceat(sums, offsets[:-1][full]) / np.maximum(n[full] - 1, 1)
    return out


@dataclass
class Network:
    """Two layers, standardised inputs and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 1500, seed: int = 7) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature is fitted on the last fifth. Without
    rows of both labels, the score is the share of label 1 (one half without rows)."""
    r = np.random.default_rng(seed)
    d = x.shape[1]
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    order = r.permutation(len(y))
    cut = max(1, len(y) // 5)
    hold, own = order[:cut], order[cut:]
    xs, ys = x[own].astype(np.float64), y[own].astype(np.float64)
    mean, scale = xs.mean(0), xs.std(0) + 1e-3
    z = (xs - mean) / scale
    p = [r.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        k = r.integers(0, len(z), min(256, len(z)))
        a = np.tanh(z[k] @ p[0] + p[1])
        g = (1 / (1 + np.exp(-(a @ p[2] + p[3]))) - ys[k]) / len(k)
        back = np.outer(g, p[2]) * (1 - a * a)
        for i, grad in enumerate((z[k].T @ back + 1e-4 * p[0], back.sum(0), a.T @ g + 1e-4 * p[2], g.sum(keepdims=True))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            p[i] = p[i] - 0.01 * (1 - t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logits, truth = net.logits(x[hold].astype(np.float64)), y[hold]
    loss = lambda t: np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / t))
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rid_col: str | None = None, label_id_col: str | None = None) -> DataFrame:
    """(id, rid, held_out, score) per row of ``docs``.

    Labels of rows whose crc32(id as text) mod 3 is 1 are never learnt from; null labels aren't either, and of a document
    labelled twice the smallest label counts. Null and empty texts get a score like any other; rows with null
    identifiers aren't held out and have no label. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.col(text_col).alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(rows, "text"))

    def pool(batches):
        for batch in batches:
            x = pooled(batch.column("text"), vectors.value).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "rid", "x"])

    features = materialise(rows.select(F.col("id").cast("long").alias("id"), "rid", "text").mapInArrow(pool, "id long, rid long, x binary"), "quality-features")
    net = _fit(spark, features, labels, label_id_col or id_col, label_col)

    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(net.score(np.frombuffer(b"".join(x), np.float16).reshape(len(x), FEATURES)))

    held: Column = F.coalesce(crc_mod("id", 3) == 1, F.lit(False))
    return features.select("id", "rid", held.alias("held_out"), F.pandas_udf(score, "double")("x").alias("score"))


def _fit(spark: SparkSession, features: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Network:
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    total = known.count()
    if total > MAX_LABELLED:  # an even share by hash, so that no task sends more than its part
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < (MAX_LABELLED << 40) // total)
    sample = features.join(known, "id").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).collect()
    sample.sort(key=lambda r: r["id"])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in sample), np.float16).reshape(len(sample), FEATURES)
    return train(x, np.array([min(1, max(0, r["y"])) for r in sample], np.int64))


def score_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_documents(docs, labels, id_col, text_col).select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a score of ``least`` or more, with the input's own columns."""
    with scratch(docs.sparkSession):
        landed = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "quality-landed", keep=True)
        flat = landed.select(F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"), "rid")
        scored = score_documents(flat, labels, "id", "text", rid_col="rid", label_id_col=id_col)
        keep = materialise(scored.where(F.col("score") >= least).select("rid"), "quality-keep", keep=True)
    return landed.join(keep, "rid", "left_semi").select("row.*")

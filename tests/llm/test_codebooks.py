"""Vector codes against brute force, and the cases of the docstring."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import codebooks

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    width = len(rows[0][1]) // 16
    x = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64).reshape(len(rows), 16, width)
    books = x[:64].transpose(1, 0, 2).copy()
    for step in range(3):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        codes = far.argmin(2)
        if step < 2:
            for p in range(16):
                for k in set(codes[:, p]):
                    own = x[codes[:, p] == k, p]
                    books[p, k] = own.sum(0) // len(own)
    error = far.min(2).sum(1)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = {label: sum(int(e) for e, r in zip(error, rows, strict=True) if r[2] == label) for label in {r[2] for r in rows}}
    return [(r[0], bytes(c.astype(np.uint8)).hex(), int(e), labels[r[2]], digest) for r, c, e in zip(rows, codes, error, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    # coarse values and copies: many ties
    x = np.round(rng.normal(size=(300, 32)) * 3) / 4
    x[200:] = x[rng.integers(0, 40, 100)]
    rows = [(int(i * 7 - 900), [float(v) for v in row], None if i % 5 == 0 else int(i % 3)) for i, row in enumerate(x)]
    found = codebooks.code_report(spark.createDataFrame(rows, KIND).repartition(5).withColumn("codes", F.lit(1)).withColumn("error", F.lit("x")))
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows))


def test_search_scans_only_the_radius():
    rng = np.random.default_rng(3)
    entries, points = rng.integers(-50, 50, (64, 4)), rng.integers(-50, 50, (500, 4))
    far = ((points[:, None] - entries[None]) ** 2).sum(2)
    for start in (np.zeros(500, np.int64), far.argmin(1)):
        code, best = codebooks.exponion(points, entries, start, codebooks.neighbour_lists(entries))
        assert (code == far.argmin(1)).all() and (best == far.min(1)).all()
    _, order_far = codebooks.neighbour_lists(entries)
    inside = sum(int(np.searchsorted(order_far[a], 4 * d, "right")) for a, d in zip(far.argmin(1), far.min(1), strict=True))
    assert inside < far.size / 3


def test_left_out_padded_and_few_rows(spark):
    rows = [(3, [0.5] * 16, 1), (1, [0.25] * 16, None), (1, [0.25] * 16, None), (None, [1.0] * 4, 2), (7, None, 1), (8, [float("nan")] * 16, 1), (9, [float("inf")] + [0.0] * 15, 1), (10, [None] + [0.0] * 15, 1), (11, [], 2)]
    found = codebooks.code_report(spark.createDataFrame(rows, KIND)).collect()
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {3: 1, 1: 2, None: 1, 11: 1}
    # entries by identifier: 1, 3, 11 (all zero), then the row without one
    assert by[1][0]["code"] == "00" * 16 and by[3][0]["code"] == "01" * 16 and by[11][0]["code"] == "02" * 16
    assert by[None][0]["code"] == "03" * 4 + "02" * 12 and all(r["error"] == 0 and r["label_error"] == 0 for r in found)


def test_empty_and_too_large(spark):
    empty = codebooks.code_report(spark.createDataFrame([], KIND))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(ValueError, match="too large"):
        codebooks.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], KIND))

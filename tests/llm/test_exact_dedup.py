import hashlib
import random
import re

import pytest
from cuewright.llm import exact_dedup as X
from pyspark.sql import functions as F


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _rows():
    r = random.Random(8)
    texts = [" ".join(r.choice("ab") for _ in range(r.randrange(1, 5))) for _ in range(12)] + ["", None, " ", "\x0b\t", "a\xa0b", "A", "x " * 60_000]
    rows = []
    for k in range(200):
        t = r.choice(texts)
        rows.append((k if k % 7 else r.randrange(50), t if t is None or k % 3 else t.replace(" ", "\t\n")))
    return [*rows, (None, "a"), (None, "only null id")]


@pytest.mark.parametrize("weak", [False, True])
def test_report_equals_brute_force(spark, weak):
    rows = _rows()
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string").coalesce(2)
    digest = (lambda t: F.crc32(t.cast("binary")) % 3) if weak else X.sha256_digest
    kwargs = {} if not weak else {"digest": lambda t: digest(t).cast("string")}
    got = X.assign(docs, batches=3, **kwargs).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted(((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)])) for i, t in rows), key=str)
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(groups)
    if not weak:
        report = X.exact_duplicates(docs)
        assert {(r.doc_id, r.text_sha256) for r in report.collect()} == {(i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}
        kept = X.drop_exact_duplicates(docs)
        assert kept.columns == docs.columns and sorted(norm(r.text) for r in kept.collect()) == sorted(groups)


def test_shuffled_hits_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_HITS", 0)
    docs = spark.createDataFrame([(2, "a b"), (1, "a  b"), (3, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in X.exact_duplicates(docs).collect()) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert X.exact_duplicates(docs.limit(0)).count() == 0


def test_hot_groups_and_several_batches(spark, monkeypatch):
    monkeypatch.setattr(X, "COMPARED", 2)
    rows = [(k, "same  text" if k % 3 else f"own {k % 50}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.exact_duplicates(docs).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, []).append(i)
    assert got == {i: (first[t][0], len(first[t])) for i, t in rows}
    few = docs.where("doc_id < 20")
    assert X.assign(few, batches=20, digest=lambda t: F.lit("one")).where("kept").count() == len({t for _, t in rows[:20]})


def test_hits_come_from_earlier_batches(spark, tmp_path, monkeypatch):
    paths = []
    monkeypatch.setattr(X, "new_path", lambda own, name: paths.append(f"{tmp_path}/{name}") or paths[-1])
    rows = spark.createDataFrame([(k, f"t{k % 6}", k) for k in range(40)], "id long, digest string, rid long").coalesce(1).withColumn("locator", F.struct(F.lit(1).alias("n_bytes"), "rid"))
    X.land(rows, f"{tmp_path}/landed")
    state = X.run_stream(spark, f"{tmp_path}/landed", rows.schema, lambda r: r.select("digest", "id", "rid", "locator")).collect()
    assert sorted((r["digest"], r["first"]["id"], r["group_size"]) for r in state) == [(f"t{k}", k, 7 if k < 4 else 6) for k in range(6)]
    batches = spark.read.parquet(paths[0])
    assert batches.select("batch").distinct().count() >= X.BATCHES
    # every later batch finds the groups that the first began
    assert batches.where("batch > 0 and first.id < 6").count() >= 6 * (X.BATCHES - 1) - 3


def test_few_rows_make_as_many_batches(spark, tmp_path):
    for n in (0, 1, 3):
        docs = spark.createDataFrame([(k, "a") for k in range(n)], "doc_id long, text string")
        assert X.exact_duplicates(docs).where("kept").count() == min(n, 1)

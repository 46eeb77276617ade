import random
import re

import corpus_pipeline
from cuewright.llm import mixing, quality
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_near_copies import brute_kept

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, path):
    r = random.Random(6)
    words = [f"wort{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench = [(k, text(30)) for k in range(6)]
    docs = []
    for k in range(160):
        t = text(r.randrange(20, 120))
        if k % 8 == 1:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif k % 8 == 2:
            t = docs[-2][1].replace(" ", "\n ")
        elif k % 8 == 3:
            t = text(20) + " " + bench[k % 6][1] + " " + text(20)
        docs.append((k, t, "en", r.choice(["s1", "s2", "s3"]), len(t)))
    labels = [(k, int(k % 8 != 1), 0) for k in range(160) if k % 2 or k % 3]
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), (5, docs[5][1], "en", "s1", 9)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return bench


def test_every_stage_against_brute_force(spark, tmp_path):
    path = str(tmp_path)
    bench = _tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), number in zip(corpus_pipeline.STAGES, (2, 3, 7, 8, 10), strict=True):
        before = docs.collect()
        stage(spark, docs, path).write.parquet(f"{path}/out{number}")
        after_df = spark.read.parquet(f"{path}/out{number}")
        after = after_df.collect()
        key = lambda x: (x.doc_id, x.text)
        if number < 10:
            assert after_df.columns == docs.columns
        if number == 2:
            scores = quality.score_report(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()
            assert sorted(x.doc_id for x in scores if x.score >= 0.5) == sorted(x.doc_id for x in after)
            junk = {k for k in range(160) if k % 8 == 1}
            assert not junk & {x.doc_id for x in after} and len(after) >= len(before) - len(junk) - 3
        elif number == 3:
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            first = {}
            for x in sorted(before, key=lambda x: x.doc_id):
                first.setdefault(norm(x.text), x.doc_id)
            assert sorted((x.doc_id, norm(x.text)) for x in after) == sorted((i, t) for t, i in first.items())
        elif number == 7:
            assert sorted((x.doc_id for x in after), key=str) == sorted(brute_kept([(x.doc_id, x.text) for x in before if x.doc_id is not None]), key=str)
        elif number == 8:
            leaks = {x[0] for x in brute_leaks([(x.doc_id, x.text) for x in before], bench)}
            assert sorted(map(key, after), key=str) == sorted((key(x) for x in before if x.doc_id not in leaks), key=str) and leaks
        else:
            sizes = {}
            for x in before:
                sizes[x.source] = sizes.get(x.source, 0) + len((x.text or "").split())
            want = mixing.source_targets(sizes)
            source = {x.doc_id: x.source for x in before}
            assert sorted(x.doc_id for x in after) == sorted(source)
            for s, n in sizes.items():
                own = [x for x in after if source[x.doc_id] == s]
                assert sum(x.size for x in own) == n and all(x.taken in (0, x.size, 2 * x.size) for x in own)
                assert abs(sum(x.taken for x in own) - want[s]) <= max(x.size for x in own) / 2 + 1
        docs = after_df


def test_run(spark, tmp_path):
    _tables(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and 60 < got.count() < 150
    assert got.agg(F.sum("taken")).head()[0] > 0

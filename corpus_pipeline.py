"""The corpus pipeline: five stages from raw documents to a mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm import decontaminate, exact_dedup, mixing, near_copies, quality
from cuewright.llm.common import materialise, noted, remove

#: Tables in the shared folder that earlier stages' results read.
_left: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Remove what the stages before left in the shared folder, unless ``docs`` still reads it: it has been written by then."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left and not any(path.removeprefix("file://") in file for file in docs.inputFiles() for path in _left):
            while _left:
                remove(spark, _left.pop())
        with noted() as paths:
            out = work(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run_stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the held-out labels are never learnt from."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after white-space normalisation, the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by SimHash fingerprints within three bits or by a five-word shingle similarity of 0.8 or more, the smallest doc_id
    stays."""
    return near_copies.drop_near_copies(docs)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix),
]
#: SQL can't express the classifier or the shingles; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

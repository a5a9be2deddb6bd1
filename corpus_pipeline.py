"""A corpus in five stages: quality, near-duplicates, decontamination, personal data, mixing.

Each stage reads what its predecessor wrote. The first four return the columns of their input; the last returns the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from straitline.llm import decontaminate, jaccard, mixing, pii, quality
from straitline.llm.common import materialize
from straitline.session import ensure_workers

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, ensure_workers(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return jaccard.deduplicate(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, ensure_workers(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_workers(spark)
    return pii.redact(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _quality),
    ("ngram_jaccard_join", _near_duplicates),
    ("benchmark_decontamination", _decontaminate),
    ("personal_data", _personal_data),
    ("source_mixing", _mix),
]

#: No SQL: the first stage is a trained model. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}

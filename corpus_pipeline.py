"""The corpus pipeline: language ID, quality rules, near-dedup, best-fit packing. Each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.dedup import dedup_stage
from tessera.llm.language import language_stage
from tessera.llm.packing import packing_stage
from tessera.llm.quality import quality_stage
from tessera.llm.runtime import cut

STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("packing", packing_stage),
]
#: SQL can't express language ID, MinHash verification or tokenisation; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

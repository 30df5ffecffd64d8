"""The text pipeline: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet in the session's shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import op1_decontamination, op2_bpe, op5_near_dedup, op6_secrets, op9_quality
from kerbline.session import cut_lineage

STAGES = [
    ("quality", op9_quality.stage),
    ("near_dedup", op5_near_dedup.stage),
    ("decontamination", op1_decontamination.stage),
    ("secrets", op6_secrets.stage),
    ("bpe", op2_bpe.stage),
]

#: SQL can express neither a learnt model nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs

"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import (
    op1_decontamination,
    op2_bpe,
    op3_licenses,
    op4_toxicity,
    op5_near_dedup,
    op6_secrets,
    op7_suffixes,
    op8_substrings,
    op9_quality,
    op10_neighbours,
    op11_negatives,
    op12_resampling,
    op13_mixing,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination.query,
        "op2_bpe": op2_bpe.query,
        "op3_licenses": op3_licenses.query,
        "op4_toxicity": op4_toxicity.query,
        "op5_near_dedup": op5_near_dedup.query,
        "op6_secrets": op6_secrets.query,
        "op7_suffixes": op7_suffixes.query,
        "op8_substrings": op8_substrings.query,
        "op10_neighbours": op10_neighbours.query,
        "op9_quality": op9_quality.query,
        "op11_negatives": op11_negatives.query,
        "op12_resampling": op12_resampling.query,
        "op13_mixing": op13_mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licenses": op3_licenses.oracle(),
        "op5_near_dedup": op5_near_dedup.oracle(),
        "op7_suffixes": op7_suffixes.oracle(),
        "op8_substrings": op8_substrings.oracle(),
        "op11_negatives": op11_negatives.oracle(),
        "op12_resampling": op12_resampling.oracle(),
        "op13_mixing": op13_mixing.oracle(),
    }

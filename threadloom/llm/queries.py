"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, license_scan, line_dedup, near_dedup, quality, segmentation, sharding, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_sharding": sharding.op2_sharding,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_ngram_jaccard_join": near_dedup.op4_ngram_jaccard_join,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_quality": quality.op7_quality,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_segmentation": segmentation.op9_segmentation,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op2_sharding": sharding.OP2_SQL,
        "op3_decontamination": decontaminate.OP3_SQL,
        "op4_ngram_jaccard_join": near_dedup.OP4_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
    }

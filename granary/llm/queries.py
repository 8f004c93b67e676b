"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fill_in_middle, language_id, license_scan, minhash_dedup, period_runs, piece_encoding, quality_rules, secret_scan, source_mixing, substring_dedup, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_language_id": language_id.op9_language_id,
        "op10_source_mixing": source_mixing.op10_source_mixing,
        "op11_period_runs": period_runs.op11_period_runs,
        "op12_piece_encoding": piece_encoding.op12_piece_encoding,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.OP1_SQL, "op6_substring_dedup": substring_dedup.OP6_SQL, "op10_source_mixing": source_mixing.OP10_SQL, "op13_fill_in_middle": fill_in_middle.OP13_SQL}

"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_chat_formatting
from .decontaminate import op3_benchmark_decontamination
from .html import op4_html_extraction
from .kneser import op6_quality_classifier
from .minhash import op5_minhash_near_dedup
from .packing import op10_best_fit_packing
from .pii import op9_pii
from .repeats import op7_suffix_array_dedup
from .rules import op8_quality_rules
from .tokencount import op1_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_html_extraction": op4_html_extraction,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_pii": op9_pii,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL}

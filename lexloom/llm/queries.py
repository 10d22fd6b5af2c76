"""The registered queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op3_byte_bpe
from .decontaminate import op5_decontaminate
from .near_dup import op8_near_dup
from .quality import OP10_SQL, op10_quality_rules
from .secrets import op7_secret_scan
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op2_suffix_dedup
from .token_store import op6_token_store
from .toxicity import op4_toxicity
from .url_filter import OP9_SQL, op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_store": op6_token_store,
    "op7_secret_scan": op7_secret_scan,
    "op8_near_dup": op8_near_dup,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op9_url_filter": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
}

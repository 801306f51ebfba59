"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotrain, crosspoly, fuzzyhash, langmask, linedup, packing, substring, token_rollup, winnow, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_rollup": token_rollup.op1_token_rollup,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_html_extraction": wrappers.op3_html_extraction,
    "op4_packing": packing.op4_packing,
    "op5_simhash_near_dedup": fuzzyhash.op5_simhash_near_dedup,
    "op6_quality": cotrain.op6_quality,
    "op7_decontamination": winnow.op7_decontamination,
    "op8_nearest_neighbours": crosspoly.op8_nearest_neighbours,
    "op9_line_dedup": linedup.op9_line_dedup,
    "op10_language_id": langmask.op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring.OP2_SQL,
    "op7_decontamination": winnow.OP7_SQL,
    "op9_line_dedup": linedup.OP9_SQL,
}

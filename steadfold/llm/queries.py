"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

#: Module and query of each operator.
OPERATORS = {
    "language_id": "op1_language_id",
    "simhash": "op2_simhash",
    "url_filter": "op3_url_filter",
    "quality_rules": "op4_quality_rules",
    "token_files": "op5_token_files",
    "mixing": "op6_mixing",
    "license_scan": "op7_license_scan",
    "toxicity": "op8_toxicity",
    "decontaminate": "op9_decontaminate",
    "line_dedup": "op10_line_dedup",
    "personal_data": "op11_personal_data",
    "fill_middle": "op12_fill_middle",
    "centroids": "op13_centroids",
}
#: Further queries of an operator: module, query, the name of its SQL.
MORE = (("quality_rules", "quality_ablation", "ABLATION_SQL"), ("mixing", "mixing_targets", "TARGETS_SQL"))


def _module(name: str) -> ModuleType:
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [(module, query) for module, query in OPERATORS.items()] + [(module, query) for module, query, _ in MORE]
    return {query: getattr(_module(module), query) for module, query in named}


def oracle_sql() -> dict[str, str]:
    found = {query: getattr(_module(module), "SQL", None) for module, query in OPERATORS.items()}
    found |= {query: getattr(_module(module), sql) for module, query, sql in MORE}
    return {query: sql for query, sql in found.items() if sql}

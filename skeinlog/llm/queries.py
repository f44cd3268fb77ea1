"""The queries of the training-data operators, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "mixlm": "op5_mixlm",
    "toxicity": "op2_toxicity",
    "neardup": "op3_neardup",
    "decontaminate": "op1_decontaminate",
    "mixing": "op4_mixing",
    "quality": "op6_quality",
    "warc": "op7_warc",
    "chat": "op8_chat",
    "secrets": "op9_secrets",
    "shards": "op10_sharding",
    "language": "op11_language",
    "alignment": "op12_alignment",
    "prefixes": "op13_prefixes",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query: getattr(import_module(f"skeinlog.llm.{module}"), query) for module, query in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module, query in MODULES.items():
        sql = getattr(import_module(f"skeinlog.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[query] = sql
    return out

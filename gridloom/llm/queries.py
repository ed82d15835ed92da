"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module and function of each query; its SQL, if any, is the module's OPn_SQL.
_WHERE = {
    "op1_secret_scan": "q_secrets",
    "op2_ngram_join": "q_ngrams",
    "op3_chat_format": "q_chat",
    "op4_language_id": "q_language",
    "op5_packing": "q_packing",
    "op6_repeated_passages": "q_repeats",
    "op7_toxicity": "q_toxicity",
    "op8_quality": "q_quality",
    "op9_decontamination": "q_benchmark",
    "op10_nearest_neighbours": "q_nearest",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"gridloom.llm.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"gridloom.llm.{module}"), f"{name.split('_')[0].upper()}_SQL", None) for name, module in _WHERE.items()}
    return {name: sql for name, sql in found.items() if sql}

"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_eval, q_ml, q_models, q_pipeline, q_profile  # noqa: F401  (registers queries)
from .registry import REGISTRY, oracle_text, spark_callable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spark_callable(name) for name in REGISTRY}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in REGISTRY:
        text = oracle_text(name)
        if text is not None:
            out[name] = text
    return out

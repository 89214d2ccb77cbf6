"""Named queries over the driver tables and the SQL each is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.common import TIE_NUDGE
from ..session import apply_runtime_conf
from .bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CATALOGS = ("scalar_queries", "quality_queries", "temporal_queries", "feature_queries", "evaluation_queries",
            "model_queries", "decision_queries", "service_queries")


def nudge_rounding(sql: str) -> str:
    """Give every ``round(x, 6) + 0.0`` of a check the tie factor that r6 applies in Spark."""
    tail, at = ", 6) + 0.0", 0
    while (end := sql.find(tail, at)) >= 0:
        depth, start = 0, end
        while depth >= 0:
            start -= 1
            depth += {")": 1, "(": -1}.get(sql[start], 0)
        if sql[:start].endswith("round"):
            inner = f"({sql[start + 1:end]}) * {TIE_NUDGE!r}e0"
            sql = sql[:start + 1] + inner + sql[end:]
            end = start + 1 + len(inner)
        at = end + len(tail)
    return sql


def query(name: str, sql: str | None = None):
    """Register a query taking Tables; sql is the equivalent text for the check, where one exists."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(apply_runtime_conf(spark), folder))

        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = nudge_rounding(sql)
        return fn
    return register


def load() -> None:
    for module in CATALOGS:
        importlib.import_module(f"prematch.plans.{module}")

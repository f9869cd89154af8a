"""Every registered query of the core with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwright.plans import analytics, measured, reading

MODULES = (analytics, measured, reading)

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages of every question, with the rules that moved them."""
    return analytics.search_topk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}

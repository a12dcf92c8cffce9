"""Queries of this subpackage with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotgrid.session import attach

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``function(spark, sf_dir)`` under a name, with SQL that must agree."""
    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(attach(spark), sf_dir)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return function

    return add

"""The registered queries over books and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookweave.plans import consolidation, funds, history, intake, records, risk, runs, trust, valuation  # noqa: F401
# Importing these modules registers their queries.
from bookweave.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals per book."""
    return valuation.fin1_value_books(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

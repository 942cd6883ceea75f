"""A query and its oracle under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.sources.tables import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Added before rounding, so that values on the border between two roundings go the same way in every engine.
NUDGE = "1e-7"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name; sql follows the common views."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {VIEWS}{sql}".replace("round(", f"round({NUDGE} + ")
        return f

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with its doubles rounded, without negative zero, and its dates as text."""
    cast = {"double": lambda c: F.round(c + float(NUDGE), digits) + 0.0, "date": lambda c: c.cast("string")}
    return df.select(*(cast[t](F.col(c)).alias(c) if t in cast else F.col(c) for c, t in df.dtypes))


def share(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(a if isinstance(a, Column) else F.col(a), b if isinstance(b, Column) else F.col(b))

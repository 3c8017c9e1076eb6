"""Where query functions sign in, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WIDE = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}


def widened(frame: DataFrame) -> DataFrame:
    """Integers as longs and floats as doubles, so that both engines give the same types."""
    kinds = {c: _WIDE.get(t, "double" if t.startswith("decimal") else None) for c, t in frame.dtypes}
    return frame.select(*(F.col(c).cast(k).alias(c) if k else F.col(c) for c, k in kinds.items()))


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(spark, sf_dir)`` under its own name; ``sql`` gives the same rows in DuckDB."""

    def sign(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: widened(f(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return sign

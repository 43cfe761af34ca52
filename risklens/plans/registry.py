from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.sources.readers import read_testdata

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its oracle."""
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_testdata(spark, sf_dir, name)


def rnd(c, d: int) -> Column:
    """Round a double for engine-independent comparison (``round`` in SQL)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, d)


def ms_round(c) -> Column:
    """Millisecond value rounded to the nanosecond: ``round(x * 1000, 3) / 1000``.

    Rounding in microseconds keeps exact half-microsecond results (two gaps)
    away from decimal ties that engines break differently."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * 1000, 3) / 1000

"""Equi joins whose key may hold a large share of one side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the large side up to which a plain join is left to Spark.
PLAIN_ROWS = 2_000_000
#: A key is hot if it holds more than one in so many rows; hence no more keys than that can be hot.
HOT_SHARE = 10_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that must not be broadcast: a table that grows with
    the input may be small enough as a file or a shuffle, which is compressed, and
    still be a load for the driver, through which each broadcast goes."""
    return df.hint("merge")


def spread_join(large: DataFrame, keyed: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join ``large`` with ``keyed``, which has one row a ``key``; ``how``: inner
    or left; ``rows``: number of rows of ``large``, where it is known.

    Rows of hot keys stay where they are and meet the few rows of ``keyed`` that
    belong to hot keys by a broadcast, whose size is bounded by counting; all
    others are joined by a shuffle, in which no key has more than one in
    ``HOT_SHARE`` rows. Both inputs are read twice, so they should be written
    tables. A null key meets nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    n = large.count() if rows is None else rows
    if n <= PLAIN_ROWS:
        return large.join(shuffled(keyed), on=key, how=how)
    # hot keys that have no row in ``keyed`` count too: they must not reach the shuffle either
    hot = large.groupBy(key).agg(F.count("*").alias("_held")).where(F.col("_held") * HOT_SHARE > n).select(key)
    named = F.broadcast(hot.select(F.col(key).alias("_hot")))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    of_hot = keyed.join(F.broadcast(hot), on=key, how="left_semi")
    return (large.join(named, same, "left_semi").join(F.broadcast(of_hot), on=key, how=how)
            .unionByName(large.join(named, same, "left_anti").join(shuffled(keyed), on=key, how=how)))

"""Quantile cut-offs and equal-width histograms (PF9, AG5-AG10, CJ3, CJ5).

Scalars such as a quantile or the bounds of a histogram are scalar
subqueries (``DataFrame.scalar()``): Spark evaluates them once as a small
aggregate job and substitutes the value, so no cross join is planned and no
value travels through user code on the driver. Per-slice bounds are a
grouped aggregate joined back on the slice key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens import defaults as D


def quantile_value(df: DataFrame, col: str, q: float,
                   relative_error: float = D.QUANTILE_RELATIVE_ERROR) -> Column:
    """Approximate ``q``-quantile of ``col`` as a scalar-subquery column.

    Same contract as ``approxQuantile(col, [q], relative_error)``: a value of
    the column whose rank is within ``relative_error * n`` of ``q * n``. The
    sketch is merged map-side, so skew does not matter. With an error of 0 the
    value is found at once by ``exact_quantile``.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    if relative_error == 0:
        return F.lit(exact_quantile(df, col, q)).cast("double")
    accuracy = _accuracy(relative_error)
    valid = F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))
    return df.where(valid).select(
        F.percentile_approx(col, q, accuracy).alias("q")).scalar()


#: Ranges that one counting pass of ``exact_quantile`` tells apart.
RANGES = 1024


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """The exact ``q``-quantile of ``col`` as a double: the least value that has at
    least ``q * n`` values at or below it (the least of all for q = 0); NULL and
    NaN don't count, and without any value it is None.

    Selection by counting: each pass counts the values of ``RANGES`` equal ranges
    (one aggregate of at most as many rows, combined map-side) and goes on in the
    one that holds the wanted rank, between its least and largest value, until
    these are equal. Nothing is sorted or shuffled but the counts.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    x = F.col("x")
    vals = df.select(F.col(col).cast("double").alias("x")).where(_valid(x))
    finite = F.abs(x) < float("inf")
    all_ = vals.agg(F.count("*").alias("n"), F.count_if(x == float("-inf")).alias("below"), F.count_if(finite).alias("finite"),
                    F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi")).first()
    if not all_["n"]:
        return None
    rank = max(1, math.ceil(q * all_["n"])) - all_["below"]
    if rank <= 0:
        return float("-inf")
    if rank > all_["finite"]:
        return float("inf")
    lo, hi = all_["lo"], all_["hi"]
    while lo < hi:
        # halves, since the span of two doubles may be no double
        share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
        at = F.least(F.floor(share * RANGES), F.lit(RANGES - 1))
        bins = (vals.where(x.between(lo, hi)).groupBy(at.alias("at"))
                .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        for b in sorted(bins, key=lambda r: r["at"]):  # at most RANGES rows
            if rank <= b["n"]:
                lo, hi = b["lo"], b["hi"]
                break
            rank -= b["n"]
    return lo


def _accuracy(relative_error: float) -> int:
    if relative_error <= 0:
        raise ValueError("relative_error must be positive")
    return max(1, int(round(1.0 / relative_error)))


def filter_by_quantile(df: DataFrame, col: str, q: float = D.QUANTILE,
                       relative_error: float = D.QUANTILE_RELATIVE_ERROR,
                       strict: bool = False) -> DataFrame:
    """PF9: keep rows with ``col <= quantile`` (``<`` when ``strict``)."""
    cut = quantile_value(df, col, q, relative_error)
    cond = F.col(col) < cut if strict else F.col(col) <= cut
    return df.where(cond)


def _valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def histogram(df: DataFrame, col: str, n: int = D.HISTOGRAM_BINS,
              by: list[str] | None = None, anchor: str = "min", q: float = D.QUANTILE,
              relative_error: float = D.QUANTILE_RELATIVE_ERROR, zero_bin: bool = False,
              unit_width: bool = False) -> DataFrame:
    """Equal-width histogram of ``col`` -> (*by, bin, cnt, lo, hi).

    * ``anchor="min"`` (AG7/CJ3): ``lo = min``, ``hi = max``,
      ``bin = floor((x - lo) / ((hi - lo) / n))``; bins 0..n (the maximum
      lands in bin n). A constant column puts everything in bin 0.
    * ``anchor="quantile"`` (AG8/CJ5): only ``x < p``, with ``p`` the
      ``q``-quantile, ``lo = min``, ``hi = p``,
      ``bin = floor((x - p) / ((p - lo) / n))``; bins -n..-1.
    * ``zero_bin=True`` (AG9): exact zeros are counted in bin -1; other values
      fall in right-closed bins ``(w*i, w*(i+1)]`` counted from 0 with
      ``w = (hi - lo) / n``; only bins 0..n-1 are reported.
    * ``unit_width=True`` (AG10): ``bin = floor(x)``.

    NULL and NaN values are excluded. With ``by``, bounds are computed per
    slice (one grouped aggregate joined back on the slice key) instead of a
    driver loop over slices; slices without a valid value produce no rows.
    """
    by = list(by or [])
    if n < 1:
        raise ValueError("n must be >= 1")
    xd = F.col(col).cast("double")
    vals = df.select(*by, xd.alias("x")).where(_valid(F.col("x")))
    if unit_width:
        return (vals.groupBy(*by, F.floor("x").alias("bin"))
                .agg(F.count("*").alias("cnt")))

    if anchor == "quantile":
        if by:
            raise ValueError("quantile anchor is global only")
        hi = (F.lit(exact_quantile(vals, "x", q)) if relative_error == 0
              else F.percentile_approx("x", q, _accuracy(relative_error)))
        b = vals.select(F.struct(F.min("x").alias("lo"), hi.cast("double").alias("hi")).alias("b")).scalar()
        data = vals.select("x", b["lo"].alias("lo"), b["hi"].alias("hi")) \
            .where(F.col("x") < F.col("hi"))
        origin = F.col("hi")
    elif anchor == "min":
        if by:
            bounds = vals.groupBy(*by).agg(F.min("x").alias("lo"),
                                          F.max("x").alias("hi"))
            data = vals.join(bounds, on=by, how="inner")
        else:
            # one scalar subquery, one pass, for both bounds
            b = vals.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))
                            .alias("b")).scalar()
            data = vals.select("x", b["lo"].alias("lo"), b["hi"].alias("hi"))
        origin = F.col("lo")
    else:
        raise ValueError("anchor must be 'min' or 'quantile'")

    width = (F.col("hi") - F.col("lo")) / F.lit(float(n))
    if zero_bin:
        steps = F.ceil(F.try_divide(F.col("x"), width)) - 1
        b = (F.when(F.col("x") == 0, F.lit(-1))
             .when((F.col("x") > 0) & (steps < n), steps))
        data = data.withColumn("bin", b.cast("long")).where(F.col("bin").isNotNull())
    else:
        b = F.floor(F.try_divide(F.col("x") - origin, width))
        data = data.withColumn("bin", F.coalesce(b, F.lit(0)).cast("long"))
    return data.groupBy(*by, "bin", "lo", "hi").agg(F.count("*").alias("cnt"))


def histogram_string(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Report form ``bin:cnt,bin:cnt,...`` (sorted by bin) per slice. A slice's
    bins are bounded by the histogram's resolution."""
    by = list(by or [])
    pairs = F.array_sort(F.collect_list(F.struct("bin", "cnt")))
    text = F.concat_ws(",", F.transform(
        pairs, lambda s: F.concat_ws(":", s["bin"], s["cnt"])))
    return hist.groupBy(*by, "lo", "hi").agg(text.alias("bins"))


def report_line(hist: DataFrame, slice_col: str, interval_s: int) -> DataFrame:
    """IO9: the full report line per slice -> ``(begin, end, interval_s, max_value,
    min_value, bins)``, ``slice_col`` being the slice's start time."""
    start = F.col(slice_col)
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(interval_s))
    return (histogram_string(hist, by=[slice_col])
            .select(start.alias("begin"), end.cast(hist.schema[slice_col].dataType).alias("end"),
                    F.lit(interval_s).alias("interval_s"), F.col("hi").alias("max_value"),
                    F.col("lo").alias("min_value"), "bins"))


def undefined_count(df: DataFrame, col: str) -> DataFrame:
    """PF8: number of rows whose ``col`` is NULL or NaN."""
    x = F.col(col).cast("double")
    return df.agg(F.count_if(x.isNull() | F.isnan(x)).alias("n_undefined"))

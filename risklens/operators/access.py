"""Access regularity and frequency (CJ1, CJ2, CJ4, CJ5, CJ6, WN1, U1, U2).

Inter-arrival statistics are built from window functions and aggregates,
never from per-row UDFs over a concatenated timestamp string:

* the mean gap of a sorted set of distinct timestamps telescopes to
  ``(max - min) / (n - 1)``, a plain aggregate;
* the spread of gaps needs consecutive pairs. A hot key could hold a third
  of all rows, so pairs are formed inside sub-chunks of the bucket
  (``partitionBy(keys, bucket, chunk)``), and the one gap that crosses each
  chunk border comes from a second, tiny window over per-chunk min/max
  (at most bucket/chunk rows per group). Gap rows then feed ``avg`` /
  ``stddev_pop``, which combine map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risklens import defaults as D
from risklens.functions.time import bucket_columns, bucket_label, epoch_micros, timestamp_literal
from risklens.operators.stats import quantile_value

_US_PER_MS = 1000.0


def access_frequency(df: DataFrame, keys: list[str], ts: str, interval_s: int,
                     value_col: str | None = None, values=None,
                     unit: str = "hour") -> DataFrame:
    """CJ4 / AG1: rows per (keys, value_col, bucket) -> ``frequency``.

    ``values`` restricts ``value_col`` to an IN-list (PF6); NULL keys are
    dropped (PF4).
    """
    group = list(keys) + ([value_col] if value_col else [])
    d = _not_null(df, group + [ts])
    if values is not None:
        if value_col is None:
            raise ValueError("values needs value_col")
        d = d.where(F.col(value_col).isin(list(values)))
    start, _ = bucket_columns(d, ts, interval_s, unit)
    out = (d.groupBy(*group, start.alias("bucket_start"))
           .agg(F.count("*").alias("frequency")))
    return out.withColumn("bucket_label", bucket_label(F.col("bucket_start"), unit))


def frequency_cv(freq: DataFrame, keys: list[str]) -> DataFrame:
    """CJ4 / AG3 / PF14: per key, mean and sample stddev of the bucket
    frequencies and their ratio ``cv`` (NULL with a single bucket)."""
    f = F.col("frequency").cast("double")
    return (freq.groupBy(*keys)
            .agg(F.avg(f).alias("mean_frequency"), F.stddev_samp(f).alias("std_frequency"))
            .withColumn("cv", F.try_divide(F.col("std_frequency"), F.col("mean_frequency"))))


def uri_dense_rank(df: DataFrame, device: str, uri: str, ts: str, interval_s: int,
                   unit: str = "hour") -> DataFrame:
    """WN1: frequency per (device, uri, bucket) with the uri's dense rank
    inside its device as a compact id. The rank window sorts only the
    distinct (device, uri) pairs, not every bucket row of a busy device."""
    freq = access_frequency(df, [device], ts, interval_s, value_col=uri, unit=unit)
    pairs = freq.select(device, uri).distinct()
    ranked = pairs.withColumn(
        "uri_rank", F.dense_rank().over(Window.partitionBy(device).orderBy(uri)))
    return freq.join(ranked, on=[device, uri])


def _not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """IS NOT NULL conjunction (PF4), written so it reaches the parquet scan."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def _gap_table(df: DataFrame, group: list[str], ts: str, chunk_s: int) -> DataFrame:
    """Per group: ``frequency`` (all rows) and ``n_gaps``, mean and
    population stddev of the positive gaps (microseconds) between
    consecutive distinct timestamps.

    Three shuffles: the chunked window, the tiny window over chunk borders,
    and one final aggregate over the union of gap rows and per-chunk row
    counts (``avg``/``stddev_pop`` skip the NULL gaps of count rows), so no
    join is needed and every aggregate combines map-side.
    """
    t = df.select(*group, epoch_micros(df, ts).alias("t_us"))
    chunk_us = int(chunk_s) * 1_000_000
    t = t.withColumn("chunk", F.floor(F.col("t_us") / F.lit(chunk_us)))
    w_in = Window.partitionBy(*group, "chunk").orderBy("t_us")
    t = t.withColumn("gap", F.col("t_us") - F.lag("t_us").over(w_in))
    inner = t.where(F.col("gap") > 0).select(*group, "gap", F.lit(0).cast("long").alias("n"))
    per_chunk = (t.groupBy(*group, "chunk")
                 .agg(F.count("*").alias("n"), F.min("t_us").alias("t_min"),
                      F.max("t_us").alias("t_max")))
    w_chunk = Window.partitionBy(*group).orderBy("chunk")
    border = per_chunk.select(
        *group, (F.col("t_min") - F.lag("t_max").over(w_chunk)).alias("gap"), "n")
    return (inner.unionByName(border)
            .groupBy(*group)
            .agg(F.sum("n").alias("frequency"),
                 F.count("gap").alias("n_gaps"),
                 (F.avg("gap") / _US_PER_MS).alias("mean_gap_ms"),
                 (F.stddev_pop("gap") / _US_PER_MS).alias("stdev_gap_ms")))


def gap_stats(df: DataFrame, keys: list[str], ts: str, interval_s: int,
              q: float = D.QUANTILE, relative_error: float = D.QUANTILE_RELATIVE_ERROR,
              unit: str = "hour", min_stdev: float | None = None,
              chunk_s: int = D.GAP_CHUNK_SECONDS) -> DataFrame:
    """CJ1 / U1: inter-arrival statistics per (keys, bucket).

    * ``frequency`` counts all rows of the group; gaps are taken between
      distinct timestamps (duplicates collapse), in milliseconds;
    * groups with ``frequency`` above the ``q``-quantile of all group
      frequencies are dropped (ties kept, ``<=``);
    * ``mean_gap_ms`` / ``stdev_gap_ms`` are the mean and population stddev;
      groups without a positive gap are dropped, and with ``min_stdev`` also
      groups whose stddev is not above it.

    ``chunk_s`` must divide the bucket length; it bounds the rows one window
    task sorts for a hot key.
    """
    if interval_s % chunk_s:
        raise ValueError("chunk_s must divide interval_s")
    d = _not_null(df, list(keys) + [ts])
    start, _ = bucket_columns(d, ts, interval_s, unit)
    d = d.withColumn("bucket_start", start)
    group = list(keys) + ["bucket_start"]
    table = _gap_table(d, group, ts, chunk_s)
    # p80 from plain group counts: they combine map-side, where the gap table
    # would drag its window and a second shuffle of all rows into the subquery
    cut = quantile_value(d.groupBy(*group).agg(F.count("*").alias("frequency")),
                         "frequency", q, relative_error)
    out = table.where((F.col("frequency") <= cut) & (F.col("n_gaps") > 0)
                      & (F.col("mean_gap_ms") > 0))
    if min_stdev is not None:
        out = out.where(F.col("stdev_gap_ms") > min_stdev)
    return out.withColumn("bucket_label", bucket_label(F.col("bucket_start"), unit))


def regularity_spread(stats: DataFrame, keys: list[str]) -> DataFrame:
    """CJ2: per key, sample stddev of its bucket mean gaps (NULL with one
    bucket) and the number of buckets."""
    return (stats.groupBy(*keys)
            .agg(F.stddev_samp("mean_gap_ms").alias("spread_ms"),
                 F.count("*").alias("n_buckets")))


def windowed_gap_spread(df: DataFrame, keys: list[str], ts: str, start_s: int,
                        end_s: int, interval_s: int) -> DataFrame:
    """CJ6 / U2: population stddev, over windows, of the mean gap per window.

    Windows start at ``start_s, start_s + I, ...`` (strictly below
    ``end_s``) and span ``[t, t + I]`` with both ends included, so an event
    on a border belongs to two windows. Within a window the mean gap of the
    distinct timestamps is ``(max - min) / (n - 1)`` (needs n >= 2); windows
    without a positive mean are skipped. Keys with events in the range but
    without any valid window get NULL (``n_windows = 0``). One scan, bounded
    by timestamp literals that are pushed to the source.
    """
    if interval_s <= 0 or end_s <= start_s:
        raise ValueError("need interval_s > 0 and end_s > start_s")
    n_windows = -(-(end_s - start_s) // interval_s)
    step = interval_s * 1_000_000
    lo_us = start_s * 1_000_000
    d = _not_null(df, list(keys) + [ts]).where(
        (F.col(ts) >= timestamp_literal(df, ts, start_s)) & (F.col(ts) <= timestamp_literal(df, ts, start_s + n_windows * interval_s)))
    t = d.select(*keys, epoch_micros(d, ts).alias("t_us"))
    rel = F.col("t_us") - F.lit(lo_us)
    idx = F.floor(rel / F.lit(step))
    on_border = (rel % F.lit(step)) == 0
    # window i covers [lo + i*step, lo + (i+1)*step]; a border point is also
    # the closing point of window i-1.
    cand = F.array_distinct(F.array(idx, F.when(on_border, idx - 1).otherwise(idx)))
    win = (t.select(*keys, "t_us", F.explode(cand).alias("w"))
           .where((F.col("w") >= 0) & (F.col("w") < n_windows)))
    mean = (F.col("t_max") - F.col("t_min")) / ((F.col("n") - 1) * F.lit(_US_PER_MS))
    per_window = (win.groupBy(*keys, "w")
                  .agg(F.count_distinct("t_us").alias("n"),
                       F.min("t_us").alias("t_min"), F.max("t_us").alias("t_max"))
                  .withColumn("mean_gap_ms", F.when(F.col("n") >= 2, mean)))
    return (per_window.groupBy(*keys)
            .agg(F.stddev_pop("mean_gap_ms").alias("spread_ms"),
                 F.count("mean_gap_ms").alias("n_windows")))

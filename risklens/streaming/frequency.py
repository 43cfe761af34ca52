"""Incremental access frequency (CJ4) with Structured Streaming.

The access logs the jobs read are appended continuously; the same per
(client, uri, bucket) counts can be maintained as a stream: tumbling
event-time windows, a watermark bounding the state kept for late rows, and
the batch job's filters. Buckets must tile the day (the batch label restarts
every day), so the tumbling windows and the batch buckets coincide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklens.functions.time import epoch_micros


def stream_access_frequency(events: DataFrame, keys: list[str], ts: str, interval_s: int,
                            value_col: str | None = None, values=None,
                            watermark: str = "1 hour") -> DataFrame:
    """Streaming counterpart of ``access.access_frequency``.

    ``events`` is a streaming DataFrame; the result has
    ``(*keys, value_col, bucket_start, frequency)``. Use output mode
    ``append`` to emit each bucket once the watermark has passed it, or
    ``update`` for running counts.
    """
    if interval_s <= 0 or 86400 % interval_s:
        raise ValueError("interval_s must divide one day")
    group = list(keys) + ([value_col] if value_col else [])
    cond = F.col(ts).isNotNull()
    for c in group:
        cond = cond & F.col(c).isNotNull()
    d = events.where(cond)
    if values is not None:
        d = d.where(F.col(value_col).isin(list(values)))
    ntz = isinstance(events.schema[ts].dataType, T.TimestampNTZType)
    et = ts
    if ntz:
        # watermarks need TIMESTAMP: read the wall clock as UTC
        et = "_event_time"
        d = d.withColumn(et, F.timestamp_micros(epoch_micros(events, ts)))
    w = F.window(et, f"{interval_s} seconds")
    out = (d.withWatermark(et, watermark)
           .groupBy(w.alias("w"), *group)
           .agg(F.count("*").alias("frequency")))
    start = F.col("w.start")
    if ntz:
        epoch = F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType())
        start = F.timestamp_add("MICROSECOND", F.unix_micros(start), epoch)
    return out.select(*group, start.alias("bucket_start"), "frequency")

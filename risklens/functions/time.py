"""Time-bucket expressions (PF1-PF3) and exact epoch arithmetic.

All gap arithmetic runs on integer microseconds so that sums and telescoping
differences are exact; only the final statistics become doubles.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 for a timestamp or timestamp_ntz column.

    ``timestamp_ntz`` values are wall-clock times: they are converted field by
    field (days, hours, minutes, exact seconds), which never consults the
    session time zone, so a gap across a daylight-saving switch stays exact.
    """
    dtype = df.schema[col].dataType
    t = F.col(col)
    if isinstance(dtype, T.TimestampNTZType):
        days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
        hm = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long")
        sec_us = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
        return days * 86_400_000_000 + hm * 1_000_000 + sec_us
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(t)
    raise TypeError(f"{col} is {dtype.simpleString()}, expected a timestamp")


def _unit_k(interval_s: int, unit: str) -> int:
    if unit == "hour":
        k = interval_s // 3600
    elif unit == "minute":
        k = interval_s // 60
    else:
        raise ValueError("unit must be 'hour' or 'minute'")
    if k < 1:
        raise ValueError(f"interval {interval_s}s is shorter than one {unit}")
    return k


def bucket_columns(df: DataFrame, ts: str, interval_s: int,
                   unit: str = "hour") -> tuple[Column, Column]:
    """PF1/PF2: (bucket_start, bucket_label) for a tumbling bucket.

    The bucket restarts every day, as in the label ``day:floor(hour/k)*k``
    (hour form, ``k = interval/3600``) or ``day:hour:floor(minute/k)*k``
    (minute form, ``k = interval/60``). ``bucket_start`` is the real start
    time; group by it -- the label repeats every month.
    """
    k = _unit_k(interval_s, unit)
    t = F.col(ts)
    if unit == "hour":
        start = F.date_trunc("hour", t) - F.make_dt_interval(
            F.lit(0), F.hour(t) % k, F.lit(0), F.lit(0))
    else:
        start = F.date_trunc("minute", t) - F.make_dt_interval(
            F.lit(0), F.lit(0), F.minute(t) % k, F.lit(0))
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        start = start.cast(T.TimestampNTZType())
    return start, bucket_label(start, unit)


def bucket_label(start: Column, unit: str = "hour") -> Column:
    """Display label of a bucket start: ``27:6`` or ``27:6:30``."""
    if unit == "hour":
        return F.concat_ws(":", F.dayofmonth(start), F.hour(start))
    return F.concat_ws(":", F.dayofmonth(start), F.hour(start), F.minute(start))


def epoch_seconds_bucket_label(epoch_s, unit: str = "hour") -> Column:
    """PF3: label of an epoch second (an integer or a column), UTC wall clock."""
    second = epoch_s if isinstance(epoch_s, Column) else F.lit(epoch_s)
    t = F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType()) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), second)
    return bucket_label(t, unit)


def select_slice(df: DataFrame, ts: str, epoch_s: int, interval_s: int, unit: str = "hour") -> DataFrame:
    """PF3: the rows whose bucket holds epoch second ``epoch_s``: a range on
    ``ts`` itself, which is pushed to the scan."""
    k = _unit_k(interval_s, unit)
    size = k * (3600 if unit == "hour" else 60)
    # buckets restart every day (hour form) or hour (minute form)
    whole = 86_400 if unit == "hour" else 3600
    begin = epoch_s - epoch_s % whole + epoch_s % whole // size * size
    end = min(begin + size, epoch_s - epoch_s % whole + whole)
    return df.where((F.col(ts) >= timestamp_literal(df, ts, begin)) & (F.col(ts) < timestamp_literal(df, ts, end)))


def timestamp_literal(df: DataFrame, ts: str, epoch_s: int) -> Column:
    """Literal of ``ts``'s type, so that a comparison with ``ts`` reaches the scan."""
    t = datetime.fromtimestamp(epoch_s, timezone.utc)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S+00:00")).cast("timestamp")

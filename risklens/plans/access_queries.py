"""Access regularity / frequency queries on ``events``.

Fixture mapping: client = ``user_id``, uri = ``event_type``, watched uris =
click/view/purchase, one-day buckets (hour form, k = 24).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from risklens.functions.time import (
    bucket_columns, epoch_micros, epoch_seconds_bucket_label, select_slice, timestamp_literal,
)
from risklens.operators import access as A
from risklens.operators import stats as S
from risklens.plans.registry import ms_round, register, rnd, table

DAY = 86400
WATCHED = ("click", "view", "purchase")
# 6 h windows from 2024-01-01 00:00 UTC over the whole span of the events (30 days).
WIN_START, WIN_END, WIN_STEP = 1704067200, 1704067200 + 30 * DAY, 21600

_BUCKET_DAY_SQL = "date_trunc('hour', ts) - to_hours(hour(ts) % 24)"
_LABEL_SQL = "concat_ws(':', day({b}), hour({b}))"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _freq(spark, sf_dir):
    return A.access_frequency(_events(spark, sf_dir), ["user_id"], "ts", DAY,
                              value_col="event_type", values=WATCHED)


def _gap_stats(spark, sf_dir):
    return A.gap_stats(_events(spark, sf_dir), ["user_id"], "ts", DAY)


# ---------------------------------------------------------------- PF1, PF2
@register("bucket_label", """
SELECT event_id,
       date_trunc('hour', ts) - to_hours(hour(ts) % 6) AS bucket_6h,
       concat_ws(':', day(date_trunc('hour', ts) - to_hours(hour(ts) % 6)),
                      hour(date_trunc('hour', ts) - to_hours(hour(ts) % 6))) AS label_6h,
       date_trunc('minute', ts) - to_minutes(minute(ts) % 15) AS bucket_15m,
       concat_ws(':', day(date_trunc('minute', ts) - to_minutes(minute(ts) % 15)),
                      hour(date_trunc('minute', ts) - to_minutes(minute(ts) % 15)),
                      minute(date_trunc('minute', ts) - to_minutes(minute(ts) % 15))) AS label_15m
FROM events""")
def q_bucket_label(spark, sf_dir):
    ev = _events(spark, sf_dir)
    h_start, h_label = bucket_columns(ev, "ts", 6 * 3600, "hour")
    m_start, m_label = bucket_columns(ev, "ts", 15 * 60, "minute")
    return ev.select("event_id", h_start.alias("bucket_6h"), h_label.alias("label_6h"),
                     m_start.alias("bucket_15m"), m_label.alias("label_15m"))


# ---------------------------------------------------------------- CJ4
_FREQ_SQL = f"""
SELECT user_id, event_type, {_BUCKET_DAY_SQL} AS bucket_start, count(*) AS frequency
FROM events
WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL
  AND event_type IN ('click', 'view', 'purchase')
GROUP BY ALL"""


@register("access_frequency", f"""
SELECT user_id, event_type, bucket_start, {_LABEL_SQL.format(b='bucket_start')} AS bucket_label,
       frequency
FROM ({_FREQ_SQL}) f""")
def q_access_frequency(spark, sf_dir):
    return _freq(spark, sf_dir).select("user_id", "event_type", "bucket_start",
                                       "bucket_label", "frequency")


_CV_SQL = f"""
SELECT user_id, event_type, avg(frequency) AS mean_frequency,
       stddev_samp(frequency) AS std_frequency,
       stddev_samp(frequency) / nullif(avg(frequency), 0) AS cv
FROM ({_FREQ_SQL}) f GROUP BY user_id, event_type"""


@register("frequency_cv", f"""
SELECT user_id, event_type, round(mean_frequency, 9) AS mean_frequency,
       round(std_frequency, 9) AS std_frequency, round(cv, 9) AS cv
FROM ({_CV_SQL}) c""")
def q_frequency_cv(spark, sf_dir):
    cv = A.frequency_cv(_freq(spark, sf_dir), ["user_id", "event_type"])
    return cv.select("user_id", "event_type", rnd("mean_frequency", 9).alias("mean_frequency"),
                     rnd("std_frequency", 9).alias("std_frequency"), rnd("cv", 9).alias("cv"))


@register("frequency_cv_undefined", f"""
SELECT count(*) FILTER (WHERE cv IS NULL OR isnan(cv)) AS n_undefined FROM ({_CV_SQL}) c""")
def q_frequency_cv_undefined(spark, sf_dir):
    cv = A.frequency_cv(_freq(spark, sf_dir), ["user_id", "event_type"])
    return S.undefined_count(cv, "cv")


# AG8: histogram of the per-key mean frequency below its 0.8-quantile.
@register("frequency_hist_below_p80", f"""
WITH x AS (SELECT mean_frequency AS x FROM ({_CV_SQL}) c),
     b AS (SELECT quantile_disc(x, 0.8) AS hi, min(x) AS lo FROM x)
SELECT CAST(floor((x - hi) / ((hi - lo) / 100.0)) AS BIGINT) AS bin,
       round(lo, 9) AS lo, round(hi, 9) AS hi, count(*) AS cnt
FROM x, b WHERE x < hi GROUP BY ALL""")
def q_frequency_hist_below_p80(spark, sf_dir):
    cv = A.frequency_cv(_freq(spark, sf_dir), ["user_id", "event_type"])
    h = S.histogram(cv, "mean_frequency", n=100, anchor="quantile", q=0.8)
    return h.select("bin", rnd("lo", 9).alias("lo"), rnd("hi", 9).alias("hi"), "cnt")


# AG7: histogram of the coefficient of variation (values rounded to 9 places
# first so both engines bin identical doubles).
@register("cv_hist", f"""
WITH x AS (SELECT round(cv, 9) AS x FROM ({_CV_SQL}) c WHERE cv IS NOT NULL AND NOT isnan(cv)),
     b AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT CAST(coalesce(floor((x - lo) / nullif((hi - lo) / 100.0, 0)), 0) AS BIGINT) AS bin,
       lo, hi, count(*) AS cnt
FROM x, b GROUP BY ALL""")
def q_cv_hist(spark, sf_dir):
    cv = A.frequency_cv(_freq(spark, sf_dir), ["user_id", "event_type"])
    cv = cv.select(rnd("cv", 9).alias("cv"))
    return S.histogram(cv, "cv", n=100).select("bin", "lo", "hi", "cnt")


# AG10: integer-valued histogram of the mean frequency.
@register("integer_hist", f"""
SELECT CAST(floor(mean_frequency) AS BIGINT) AS bin, count(*) AS cnt
FROM ({_CV_SQL}) c GROUP BY ALL""")
def q_integer_hist(spark, sf_dir):
    cv = A.frequency_cv(_freq(spark, sf_dir), ["user_id", "event_type"])
    return S.histogram(cv, "mean_frequency", unit_width=True).select("bin", "cnt")


# ---------------------------------------------------------------- CJ1
def _gap_sql(keys: str = "user_id", min_stdev: float | None = None) -> str:
    """Oracle for gap statistics; ``keys`` is a comma-separated column list."""
    ks = [k.strip() for k in keys.split(",")]
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in ks)
    part = ", ".join(ks)
    strict = f" AND s.stdev_gap_ms > {min_stdev}" if min_stdev is not None else ""
    sel = ", ".join(f"c.{k}" for k in ks)
    return f"""
WITH b AS (SELECT {part}, {_BUCKET_DAY_SQL} AS bucket_start, epoch_us(ts) AS t_us
           FROM events WHERE {notnull} AND ts IS NOT NULL),
     counts AS (SELECT {part}, bucket_start, count(*) AS frequency FROM b GROUP BY ALL),
     d AS (SELECT DISTINCT {part}, bucket_start, t_us FROM b),
     g AS (SELECT {part}, bucket_start,
                  t_us - lag(t_us) OVER (PARTITION BY {part}, bucket_start ORDER BY t_us) AS gap
           FROM d),
     s AS (SELECT {part}, bucket_start, count(*) AS n_gaps, avg(gap) / 1000.0 AS mean_gap_ms,
                  stddev_pop(gap) / 1000.0 AS stdev_gap_ms
           FROM g WHERE gap IS NOT NULL GROUP BY ALL),
     p AS (SELECT quantile_disc(frequency, 0.8) AS p80 FROM counts)
SELECT {sel}, c.bucket_start, c.frequency, s.n_gaps, s.mean_gap_ms, s.stdev_gap_ms
FROM counts c JOIN s USING ({part}, bucket_start), p
WHERE c.frequency <= p.p80 AND s.mean_gap_ms > 0{strict}"""


_GAP_SQL = _gap_sql()


@register("gap_stats", f"""
SELECT user_id, bucket_start, {_LABEL_SQL.format(b='bucket_start')} AS bucket_label, frequency,
       n_gaps, mean_gap_ms, round(stdev_gap_ms * 1000, 3) / 1000 AS stdev_gap_ms
FROM ({_GAP_SQL}) x""")
def q_gap_stats(spark, sf_dir):
    g = _gap_stats(spark, sf_dir)
    return g.select("user_id", "bucket_start", "bucket_label", "frequency", "n_gaps",
                    "mean_gap_ms", ms_round("stdev_gap_ms").alias("stdev_gap_ms"))


_SPREAD_SQL = f"""
SELECT user_id, stddev_samp(mean_gap_ms) AS spread_ms, count(*) AS n_buckets
FROM ({_GAP_SQL}) x GROUP BY user_id"""


@register("gap_spread", f"""
SELECT user_id, round(spread_ms, 3) AS spread_ms, n_buckets FROM ({_SPREAD_SQL}) s""")
def q_gap_spread(spark, sf_dir):
    s = A.regularity_spread(_gap_stats(spark, sf_dir), ["user_id"])
    return s.select("user_id", rnd("spread_ms", 3).alias("spread_ms"), "n_buckets")


@register("gap_hist", f"""
WITH x AS (SELECT round(spread_ms, 3) AS x FROM ({_SPREAD_SQL}) s
           WHERE spread_ms IS NOT NULL AND NOT isnan(spread_ms)),
     b AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT CAST(coalesce(floor((x - lo) / nullif((hi - lo) / 100.0, 0)), 0) AS BIGINT) AS bin,
       lo, hi, count(*) AS cnt
FROM x, b GROUP BY ALL""")
def q_gap_hist(spark, sf_dir):
    s = A.regularity_spread(_gap_stats(spark, sf_dir), ["user_id"])
    s = s.select(rnd("spread_ms", 3).alias("spread_ms"))
    return S.histogram(s, "spread_ms", n=100).select("bin", "lo", "hi", "cnt")


@register("gap_hist_by_bucket", f"""
WITH x AS (SELECT bucket_start, round(stdev_gap_ms, 3) AS x FROM ({_GAP_SQL}) g
           WHERE stdev_gap_ms IS NOT NULL AND NOT isnan(stdev_gap_ms)),
     b AS (SELECT bucket_start, min(x) AS lo, max(x) AS hi FROM x GROUP BY bucket_start)
SELECT bucket_start,
       CAST(coalesce(floor((x - lo) / nullif((hi - lo) / 100.0, 0)), 0) AS BIGINT) AS bin,
       lo, hi, count(*) AS cnt
FROM x JOIN b USING (bucket_start) GROUP BY ALL""")
def q_gap_hist_by_bucket(spark, sf_dir):
    g = _gap_stats(spark, sf_dir).select("bucket_start", rnd("stdev_gap_ms", 3).alias("x"))
    return S.histogram(g, "x", n=100, by=["bucket_start"]).select(
        "bucket_start", "bin", "lo", "hi", "cnt")


# ---------------------------------------------------------------- CJ6 / U2
def _win_sql(step: int) -> str:
    return f"""
WITH t AS (SELECT user_id, epoch_us(ts) AS t_us FROM events
           WHERE user_id IS NOT NULL AND ts IS NOT NULL
             AND epoch_us(ts) BETWEEN {WIN_START}::BIGINT * 1000000
                 AND ({WIN_START} + ceil(({WIN_END} - {WIN_START}) / {step}) * {step})::BIGINT * 1000000),
     w AS (SELECT range AS w, {WIN_START}::BIGINT * 1000000 + range * {step}::BIGINT * 1000000 AS w_lo
           FROM range(0, CAST(ceil(({WIN_END} - {WIN_START}) / {step}) AS BIGINT))),
     m AS (SELECT DISTINCT t.user_id, w.w, t.t_us FROM t JOIN w
           ON t.t_us >= w.w_lo AND t.t_us <= w.w_lo + {step}::BIGINT * 1000000),
     g AS (SELECT user_id, w, t_us - lag(t_us) OVER (PARTITION BY user_id, w ORDER BY t_us) AS gap
           FROM m),
     wm AS (SELECT user_id, w, avg(gap) / 1000.0 AS mean_gap_ms FROM g
            WHERE gap IS NOT NULL GROUP BY ALL HAVING avg(gap) > 0),
     s AS (SELECT user_id, stddev_pop(mean_gap_ms) AS spread_ms, count(*) AS n_windows
           FROM wm GROUP BY user_id)
SELECT k.user_id, s.spread_ms, coalesce(s.n_windows, 0) AS n_windows
FROM (SELECT DISTINCT user_id FROM t) k LEFT JOIN s USING (user_id)"""


_WIN_SQL = _win_sql(WIN_STEP)


@register("windowed_gap_spread", f"""
SELECT user_id, round(spread_ms, 3) AS spread_ms, n_windows FROM ({_WIN_SQL}) x""")
def q_windowed_gap_spread(spark, sf_dir):
    s = A.windowed_gap_spread(_events(spark, sf_dir), ["user_id"], "ts",
                              WIN_START, WIN_END, WIN_STEP)
    return s.select("user_id", rnd("spread_ms", 3).alias("spread_ms"), "n_windows")


# AG9: separate zero bin, right-closed bins counted from 0, on the windowed
# spread.
@register("gap_hist_zero_bin", f"""
WITH x AS (SELECT round(spread_ms, 3) AS x FROM ({_WIN_SQL}) s
           WHERE spread_ms IS NOT NULL AND NOT isnan(spread_ms)),
     b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
     z AS (SELECT x, lo, hi,
                  CASE WHEN x = 0 THEN -1
                       WHEN x > 0 AND ceil(x / nullif((hi - lo) / 100.0, 0)) - 1 < 100
                       THEN CAST(ceil(x / nullif((hi - lo) / 100.0, 0)) - 1 AS BIGINT) END AS bin
           FROM x, b)
SELECT bin, lo, hi, count(*) AS cnt FROM z WHERE bin IS NOT NULL GROUP BY ALL""")
def q_gap_hist_zero_bin(spark, sf_dir):
    s = A.windowed_gap_spread(_events(spark, sf_dir), ["user_id"], "ts",
                              WIN_START, WIN_END, WIN_STEP)
    s = s.select(rnd("spread_ms", 3).alias("spread_ms"))
    return S.histogram(s, "spread_ms", n=100, zero_bin=True).select("bin", "lo", "hi", "cnt")


# ---------------------------------------------------------------- WN1
@register("uri_dense_rank", f"""
SELECT user_id, event_type, bucket_start, frequency,
       dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS uri_rank
FROM (SELECT user_id, event_type, {_BUCKET_DAY_SQL} AS bucket_start, count(*) AS frequency
      FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL
      GROUP BY ALL) f""")
def q_uri_dense_rank(spark, sf_dir):
    r = A.uri_dense_rank(_events(spark, sf_dir), "user_id", "event_type", "ts", DAY)
    return r.select("user_id", "event_type", "bucket_start", "frequency",
                    F.col("uri_rank").cast("long").alias("uri_rank"))


# CJ1 with the jobs' own grouping (client and uri) and the stricter
# ``stdev > 0`` filter (PF10).
@register("gap_stats_uri", f"""
SELECT user_id, event_type, bucket_start, frequency, n_gaps, mean_gap_ms,
       round(stdev_gap_ms * 1000, 3) / 1000 AS stdev_gap_ms
FROM ({_gap_sql("user_id, event_type")}) x""")
def q_gap_stats_uri(spark, sf_dir):
    g = A.gap_stats(_events(spark, sf_dir), ["user_id", "event_type"], "ts", DAY)
    return g.select("user_id", "event_type", "bucket_start", "frequency", "n_gaps",
                    "mean_gap_ms", ms_round("stdev_gap_ms").alias("stdev_gap_ms"))


@register("gap_stats_min_stdev", f"""
SELECT user_id, bucket_start, frequency, n_gaps, mean_gap_ms,
       round(stdev_gap_ms * 1000, 3) / 1000 AS stdev_gap_ms
FROM ({_gap_sql("user_id", 0.0)}) x""")
def q_gap_stats_min_stdev(spark, sf_dir):
    g = A.gap_stats(_events(spark, sf_dir), ["user_id"], "ts", DAY, min_stdev=0.0)
    return g.select("user_id", "bucket_start", "frequency", "n_gaps", "mean_gap_ms",
                    ms_round("stdev_gap_ms").alias("stdev_gap_ms"))


# PF2: frequency in 15-minute buckets (minute form of the label).
@register("frequency_minute", """
SELECT user_id, event_type, bucket_start,
       concat_ws(':', day(bucket_start), hour(bucket_start), minute(bucket_start)) AS bucket_label,
       count(*) AS frequency
FROM (SELECT user_id, event_type,
             date_trunc('minute', ts) - to_minutes(minute(ts) % 15) AS bucket_start
      FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL
        AND event_type IN ('click', 'view', 'purchase')) e
GROUP BY ALL""")
def q_frequency_minute(spark, sf_dir):
    f = A.access_frequency(_events(spark, sf_dir), ["user_id"], "ts", 15 * 60,
                           value_col="event_type", values=WATCHED, unit="minute")
    return f.select("user_id", "event_type", "bucket_start", "bucket_label", "frequency")


# IO9: the report line of a histogram, ``bin:cnt`` pairs in bin order.
@register("gap_hist_report", f"""
WITH x AS (SELECT round(spread_ms, 3) AS x FROM ({_SPREAD_SQL}) s
           WHERE spread_ms IS NOT NULL AND NOT isnan(spread_ms)),
     b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
     h AS (SELECT CAST(coalesce(floor((x - lo) / nullif((hi - lo) / 100.0, 0)), 0) AS BIGINT) AS bin,
                  lo, hi, count(*) AS cnt FROM x, b GROUP BY ALL)
SELECT lo, hi, string_agg(concat(bin, ':', cnt), ',' ORDER BY bin) AS bins FROM h GROUP BY lo, hi""")
def q_gap_hist_report(spark, sf_dir):
    s = A.regularity_spread(_gap_stats(spark, sf_dir), ["user_id"])
    s = s.select(rnd("spread_ms", 3).alias("spread_ms"))
    return S.histogram_string(S.histogram(s, "spread_ms", n=100)).select("lo", "hi", "bins")


# CJ6 with a second interval (several intervals = one call each): 12 h windows.
@register("windowed_gap_spread_12h", f"""
SELECT user_id, round(spread_ms, 3) AS spread_ms, n_windows FROM ({_win_sql(43200)}) x""")
def q_windowed_gap_spread_12h(spark, sf_dir):
    s = A.windowed_gap_spread(_events(spark, sf_dir), ["user_id"], "ts", WIN_START, WIN_END, 43200)
    return s.select("user_id", rnd("spread_ms", 3).alias("spread_ms"), "n_windows")


# IO9: the full report line of every slice: begin, end, interval, maximum, minimum, bins.
@register("gap_hist_report_by_bucket", f"""
WITH x AS (SELECT bucket_start, round(stdev_gap_ms, 3) AS x FROM ({_GAP_SQL}) g
           WHERE stdev_gap_ms IS NOT NULL AND NOT isnan(stdev_gap_ms)),
     b AS (SELECT bucket_start, min(x) AS lo, max(x) AS hi FROM x GROUP BY bucket_start),
     h AS (SELECT bucket_start,
                  CAST(coalesce(floor((x - lo) / nullif((hi - lo) / 100.0, 0)), 0) AS BIGINT) AS bin,
                  lo, hi, count(*) AS cnt FROM x JOIN b USING (bucket_start) GROUP BY ALL)
SELECT bucket_start AS begin, bucket_start + to_seconds({DAY}) AS "end", {DAY} AS interval_s,
       hi AS max_value, lo AS min_value, string_agg(concat(bin, ':', cnt), ',' ORDER BY bin) AS bins
FROM h GROUP BY bucket_start, lo, hi""")
def q_gap_hist_report_by_bucket(spark, sf_dir):
    g = _gap_stats(spark, sf_dir).select("bucket_start", rnd("stdev_gap_ms", 3).alias("x"))
    return S.report_line(S.histogram(g, "x", n=100, by=["bucket_start"]), "bucket_start", DAY)


# The same line for the whole range: one slice from the range's start to its end.
@register("gap_hist_report_global", f"""
WITH x AS (SELECT round(spread_ms, 3) AS x FROM ({_SPREAD_SQL}) s
           WHERE spread_ms IS NOT NULL AND NOT isnan(spread_ms)),
     b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
     h AS (SELECT CAST(coalesce(floor((x - lo) / nullif((hi - lo) / 100.0, 0)), 0) AS BIGINT) AS bin,
                  lo, hi, count(*) AS cnt FROM x, b GROUP BY ALL)
SELECT to_timestamp({WIN_START})::TIMESTAMP AS begin, to_timestamp({WIN_END})::TIMESTAMP AS "end",
       {WIN_END - WIN_START} AS interval_s, hi AS max_value, lo AS min_value,
       string_agg(concat(bin, ':', cnt), ',' ORDER BY bin) AS bins FROM h GROUP BY lo, hi""")
def q_gap_hist_report_global(spark, sf_dir):
    ev = _events(spark, sf_dir)
    s = A.regularity_spread(_gap_stats(spark, sf_dir), ["user_id"])
    s = s.select(timestamp_literal(ev, "ts", WIN_START).alias("slice"), rnd("spread_ms", 3).alias("spread_ms"))
    return S.report_line(S.histogram(s, "spread_ms", n=100, by=["slice"]), "slice", WIN_END - WIN_START)


# PF3: label of every event's epoch second, and the slice that holds one.
@register("slice_label", """
SELECT event_id, concat_ws(':', day(ts), hour(ts)) AS label_hour,
       concat_ws(':', day(ts), hour(ts), minute(ts)) AS label_minute
FROM events WHERE ts IS NOT NULL""")
def q_slice_label(spark, sf_dir):
    ev = _events(spark, sf_dir).where(F.col("ts").isNotNull())
    second = F.floor(epoch_micros(ev, "ts") / 1_000_000).cast("long")
    return ev.select("event_id", epoch_seconds_bucket_label(second).alias("label_hour"),
                     epoch_seconds_bucket_label(second, "minute").alias("label_minute"))


@register("slice_select", f"""
SELECT event_id, user_id FROM events
WHERE date_trunc('hour', ts) - to_hours(hour(ts) % 6) = to_timestamp({WIN_START + 5 * DAY + 43200})::TIMESTAMP""")
def q_slice_select(spark, sf_dir):
    # the 6 h slice that holds 13:46:40 of the sixth day
    return select_slice(_events(spark, sf_dir), "ts", WIN_START + 5 * DAY + 49600, 6 * 3600).select("event_id", "user_id")

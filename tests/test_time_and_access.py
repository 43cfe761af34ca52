import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows
from risklens.functions.time import bucket_columns, epoch_micros
from risklens.operators import access as A

T0 = dt.datetime(2024, 1, 5, 0, 0, 0)


def events(spark, data):
    """data: list of (key, seconds after T0[, uri])."""
    recs = [(k, T0 + dt.timedelta(seconds=s), (u[0] if u else "u")) for k, s, *u in data]
    return spark.createDataFrame(recs, "k long, ts timestamp_ntz, uri string")


def test_bucket_labels_hour_and_minute(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 27, 7, 44, 10),)], "ts timestamp_ntz")
    hs, hl = bucket_columns(df, "ts", 6 * 3600, "hour")
    ms, ml = bucket_columns(df, "ts", 15 * 60, "minute")
    r = df.select(hs.alias("hs"), hl.alias("hl"), ms.alias("ms"), ml.alias("ml")).first()
    assert r.hs == dt.datetime(2024, 1, 27, 6, 0) and r.hl == "27:6"
    assert r.ms == dt.datetime(2024, 1, 27, 7, 30) and r.ml == "27:7:30"


def test_bucket_rejects_short_interval(spark):
    df = spark.createDataFrame([(T0,)], "ts timestamp_ntz")
    with pytest.raises(ValueError):
        bucket_columns(df, "ts", 1800, "hour")


def test_epoch_micros_ntz_and_ltz(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 0, 1, 5),)], "ts timestamp_ntz")
    assert df.select(epoch_micros(df, "ts").alias("u")).first().u == 1_000_005
    ltz = df.select(F.col("ts").cast("timestamp").alias("ts"))
    assert ltz.select(epoch_micros(ltz, "ts").alias("u")).first().u == 1_000_005


def test_epoch_micros_ignores_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 1, 30),), (dt.datetime(2024, 3, 10, 3, 30),),
                                (dt.datetime(1969, 12, 31, 23, 59, 59, 500000),)],
                               "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r.u for r in df.select(epoch_micros(df, "ts").alias("u")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got[1] - got[0] == 2 * 3600 * 1_000_000
    assert got[2] == -500_000


def test_gap_stats_basic(spark):
    df = events(spark, [(1, 0), (1, 1), (1, 3)])
    r = A.gap_stats(df, ["k"], "ts", 86400, q=1.0).collect()
    assert len(r) == 1
    assert r[0].mean_gap_ms == 1500.0 and r[0].stdev_gap_ms == 500.0
    assert r[0].frequency == 3 and r[0].n_gaps == 2


def test_gap_stats_one_and_two_timestamps(spark):
    df = events(spark, [(1, 0), (2, 10), (2, 20)])
    r = A.gap_stats(df, ["k"], "ts", 86400, q=1.0).collect()
    assert [x.k for x in r] == [2]
    assert r[0].stdev_gap_ms == 0.0


def test_gap_stats_duplicates_collapse_but_count(spark):
    df = events(spark, [(1, 0), (1, 0), (1, 4), (1, 4), (1, 6)])
    r = A.gap_stats(df, ["k"], "ts", 86400, q=1.0).first()
    assert r.frequency == 5 and r.n_gaps == 2 and r.mean_gap_ms == 3000.0


def test_gap_stats_quantile_cut(spark):
    data = [(1, s) for s in range(0, 50, 5)] + [(k, s) for k in range(2, 8) for s in (0, 7)]
    r = A.gap_stats(events(spark, data), ["k"], "ts", 86400, q=0.8)
    assert sorted(x.k for x in r.collect()) == list(range(2, 8))


def brute_gap_stats(data, interval_s):
    groups = {}
    for k, s in data:
        groups.setdefault((k, int(s // interval_s)), []).append(s)
    out = {}
    for g, ts in groups.items():
        d = sorted(set(ts))
        gaps = [(b - a) * 1000.0 for a, b in zip(d, d[1:])]
        if gaps and statistics.fmean(gaps) > 0:
            out[g] = (len(ts), statistics.fmean(gaps), statistics.pstdev(gaps))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_gap_stats_matches_brute_force_across_chunks(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.randrange(4), rnd.randrange(0, 3 * 3600) + rnd.choice([0, 0.5, 0.25]))
            for _ in range(400)]
    df = events(spark, data)
    got = {(r.k, int((r.bucket_start - T0).total_seconds() // 3600)):
           (r.frequency, r.mean_gap_ms, r.stdev_gap_ms)
           for r in A.gap_stats(df, ["k"], "ts", 3600, q=1.0, chunk_s=60).collect()}
    exp = brute_gap_stats(data, 3600)
    assert got.keys() == exp.keys()
    for g in exp:
        assert got[g][0] == exp[g][0]
        assert got[g][1] == pytest.approx(exp[g][1], rel=1e-12)
        assert got[g][2] == pytest.approx(exp[g][2], rel=1e-9, abs=1e-6)


def test_regularity_spread_single_bucket_is_null(spark):
    df = events(spark, [(1, 0), (1, 2), (1, 86400), (1, 86401), (2, 0), (2, 5)])
    st = A.gap_stats(df, ["k"], "ts", 86400, q=1.0)
    sp = {r.k: r for r in A.regularity_spread(st, ["k"]).collect()}
    assert sp[2].spread_ms is None and sp[2].n_buckets == 1
    assert sp[1].spread_ms == pytest.approx(statistics.stdev([2000.0, 1000.0]))


def brute_windowed(ts_list, start, end, step):
    """Spread model: windows [t, t+step] both ends included, distinct times."""
    d = sorted(set(ts_list))
    means = []
    for w in range(start, end, step):
        inside = [t for t in d if w <= t <= w + step]
        gaps = [b - a for a, b in zip(inside, inside[1:])]
        if gaps and statistics.fmean(gaps) > 0:
            means.append(statistics.fmean(gaps) * 1000.0)
    if not means:
        return None, 0
    return statistics.pstdev(means), len(means)


def test_windowed_gap_spread_matches_model_with_borders(spark):
    rnd = random.Random(7)
    start, step, end = 0, 600, 3000
    data = []
    for k in range(5):
        for _ in range(30):
            data.append((k, rnd.choice([rnd.randrange(0, 3200), 600 * rnd.randrange(0, 6)])))
    data.append((9, 100))  # key with no valid window
    data.append((8, 90_000))  # key without events in the range: no row
    df = events(spark, data)
    s0 = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    got = {r.k: (r.spread_ms, r.n_windows)
           for r in A.windowed_gap_spread(df, ["k"], "ts", s0 + start, s0 + end, step).collect()}
    assert 8 not in got
    for k in {k for k, _ in data} - {8}:
        exp = brute_windowed([s for kk, s in data if kk == k], start, end, step)
        if exp[0] is None:
            assert got[k] == (None, 0)
        else:
            assert got[k][1] == exp[1]
            assert got[k][0] == pytest.approx(exp[0], rel=1e-9, abs=1e-6)


def test_windowed_gap_spread_pushes_its_range(spark, tmp_path):
    events(spark, [(1, 10), (1, 20)]).write.parquet(str(tmp_path / "ev"))
    df = spark.read.parquet(str(tmp_path / "ev"))
    s0 = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    plan = A.windowed_gap_spread(df, ["k"], "ts", s0, s0 + 3600, 600)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert plan[plan.index("Physical Plan"):].count("FileScan") == 1


def test_select_slice_equals_bucket(spark):
    from risklens.functions.time import bucket_columns, select_slice
    df = events(spark, [(k, k * 1777) for k in range(100)])
    s0 = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    for unit, interval in (("hour", 5 * 3600), ("hour", 86400), ("minute", 25 * 60)):
        start, _ = bucket_columns(df, "ts", interval, unit)
        buckets = dict(rows(df.select("k", start.alias("b"))))
        for k in (0, 17, 60):
            got = {r.k for r in select_slice(df, "ts", s0 + k * 1777, interval, unit).collect()}
            assert got == {j for j, b in buckets.items() if b == buckets[k]}


def test_read_catalog_table(spark, tmp_path):
    from risklens.sources.readers import read_table
    spark.range(3).createOrReplaceTempView("catalog_table_of_test")
    assert rows(read_table(spark, "catalog_table_of_test")) == [(0,), (1,), (2,)]


def test_access_frequency_in_list_and_nulls(spark):
    recs = [(1, T0, "a"), (1, T0, "a"), (1, T0, "b"), (None, T0, "a"), (2, T0, None),
            (2, T0 + dt.timedelta(days=1), "a")]
    df = spark.createDataFrame(recs, "k long, ts timestamp_ntz, uri string")
    f = A.access_frequency(df, ["k"], "ts", 86400, value_col="uri", values=["a"])
    assert rows(f, "k", "uri", "frequency") == [(1, "a", 2), (2, "a", 1)]
    cv = A.frequency_cv(f, ["k", "uri"]).collect()
    assert all(r.std_frequency is None and r.cv is None for r in cv)


def test_uri_dense_rank(spark):
    recs = [(1, T0, "b"), (1, T0, "a"), (1, T0, "b"), (2, T0, "z")]
    df = spark.createDataFrame(recs, "k long, ts timestamp_ntz, uri string")
    r = A.uri_dense_rank(df, "k", "uri", "ts", 86400)
    assert rows(r, "k", "uri", "uri_rank", "frequency") == [(1, "a", 1, 1), (1, "b", 2, 2),
                                                           (2, "z", 1, 1)]


def test_read_access_log_and_slice_label(spark, tmp_path):
    from risklens.functions.time import epoch_seconds_bucket_label
    from risklens.sources.readers import read_access_log
    p = tmp_path / "log.json"
    times = {"a": "2017-02-27 06:00:05.123", "b": "2017-02-27 07:10:00", "c": "2017-02-27 06:00:05.1",
             "d": "2017-02-27 06:00:05.123456", "e": "2017-02-27 06:00:05.123456789", "f": "junk", "g": ""}
    p.write_text("".join(f'{{"ip":"{ip}","uri":"/a","timestamp":"{t}"}}\n' for ip, t in times.items()) + '{"ip":"h"}\n')
    got = {r.ip: r.ts for r in read_access_log(spark, str(p)).collect()}
    at = lambda us: dt.datetime(2017, 2, 27, 6, 0, 5, us)
    assert got == {"a": at(123000), "b": dt.datetime(2017, 2, 27, 7, 10), "c": at(100000), "d": at(123456),
                   "e": at(123456), "f": None, "g": None, "h": None}
    lab = spark.range(1).select(epoch_seconds_bucket_label(1488175200).alias("l")).first().l
    assert lab == "27:6"


def test_write_result_partitioned(spark, tmp_path):
    from risklens.sources.readers import write_result
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, bucket string")
    out = str(tmp_path / "out")
    write_result(df, out, partition_by=["bucket"])
    back = spark.read.parquet(out)
    assert sorted((r.x, r.bucket) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_gap_stats_hot_key_matches_brute_force(spark):
    rnd = random.Random(41)
    hot = [(0, rnd.randrange(0, 6 * 3600) + rnd.choice([0, 0.5])) for _ in range(600)]
    cold = [(k, rnd.randrange(0, 6 * 3600)) for k in range(1, 60) for _ in range(20)]
    data = hot + cold  # key 0 holds a third of all rows, over ~360 one-minute chunks
    df = events(spark, data)
    got = {(r.k, int((r.bucket_start - T0).total_seconds() // 21600)):
           (r.frequency, r.mean_gap_ms, r.stdev_gap_ms)
           for r in A.gap_stats(df, ["k"], "ts", 21600, q=1.0).collect()}
    exp = brute_gap_stats(data, 21600)
    assert got.keys() == exp.keys()
    assert got[(0, 0)][0] == 600
    for g in exp:
        assert got[g][1] == pytest.approx(exp[g][1], rel=1e-12)
        assert got[g][2] == pytest.approx(exp[g][2], rel=1e-9, abs=1e-6)

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from risklens.operators import stats as S
from risklens.plans import io_queries as Q
from risklens.sources import readers as IO

DOUBLES = "x double"


def exact(values, q):
    kept = sorted(v for v in values if v is not None and not math.isnan(v))
    return kept[max(1, math.ceil(q * len(kept))) - 1] if kept else None


@pytest.mark.parametrize("case", ["random", "ties", "wide", "infinite", "one", "none"])
def test_exact_quantile(spark, case):
    rnd = random.Random(4)
    values = {"random": [rnd.gauss(0, 1) for _ in range(2000)], "ties": [float(rnd.randrange(3)) for _ in range(500)] + [None, float("nan")],
              "wide": [10.0 ** rnd.randrange(-300, 300) * rnd.choice((-1, 1)) for _ in range(400)] + [1.7e308, -1.7e308],
              "infinite": [float("inf")] * 30 + [float("-inf")] * 20 + [1.0, 2.0, 3.0] * 10, "one": [5.0], "none": [None, float("nan")]}[case]
    df = spark.createDataFrame([(v,) for v in values], DOUBLES)
    for q in (0.0, 0.1, 0.5, 0.8, 1.0):
        assert S.exact_quantile(df, "x", q) == exact(values, q)
    with pytest.raises(ValueError):
        S.exact_quantile(df, "x", 1.5)


def test_error_zero_is_exact_everywhere(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 1001)], DOUBLES)
    assert df.select(S.quantile_value(df, "x", 0.8, 0).alias("q")).first()["q"] == 800.0
    assert S.filter_by_quantile(df, "x", 0.25, relative_error=0).count() == 250
    assert S.histogram(df, "x", n=4, anchor="quantile", q=0.5, relative_error=0).agg(F.sum("cnt")).first()[0] == 499


def test_scan_keeps_every_line(spark, tmp_path):
    good = '{"ip":"1","uri":"/a","dfp":"d","timestamp":"2024-01-01 10:00:00.5"}'
    lines = [good, '{"ip":"1"', "plain text", '{"ip":"2","uri":"/b"}', '{"ip":"3","timestamp":"soon"}', "", "   ",
             '{"ip":{"a":1},"timestamp":"2024-01-01 10:00:00"}', "[1, 2]", '{"extra":1,"timestamp":"2024-01-01 00:00:00"}']
    (tmp_path / "log.json").write_text("\n".join(lines))
    ok, rejected = IO.scan_access_log(spark, str(tmp_path))
    reasons = {r.line: r.reason for r in rejected.collect()}
    assert reasons['{"ip":"1"'] == reasons["plain text"] == "malformed"
    assert reasons['{"ip":"2","uri":"/b"}'] == "no timestamp" and reasons['{"ip":"3","timestamp":"soon"}'] == "bad timestamp"
    assert ok.count() + rejected.count() == sum(1 for x in lines if x.strip())
    assert {r.ip for r in ok.collect()} >= {"1", None}
    assert IO.read_access_log(spark, str(tmp_path)).where("ip = '1' and ts is not null").count() == 1


def test_a_slice_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "v long, s string")
    IO.write_slices(df, path, ["s"])
    IO.write_slices(df, path, ["s"])
    assert spark.read.parquet(path).count() == 30
    IO.write_slices(spark.createDataFrame([(100, "s1"), (7, "s9")], "v long, s string"), path, ["s"])
    got = rows(spark.read.parquet(path), "s", "v")
    assert got == sorted([(f"s{i % 3}", i) for i in range(30) if i % 3 != 1] + [("s1", 100), ("s9", 7)])


def test_bucketed_tables_join_without_shuffle(spark):
    df = Q.bucketed_hits(spark, SF_SMALL)
    assert df.count() >= 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan

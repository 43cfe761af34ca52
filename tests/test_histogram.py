import pytest

from conftest import rows
from risklens.operators import stats as S


def col(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_min_anchor_bins(spark):
    h = S.histogram(col(spark, [0.0, 50.0, 100.0]), "x", n=100)
    assert rows(h, "bin", "cnt") == [(0, 1), (50, 1), (100, 1)]


def test_constant_column_single_bin(spark):
    h = S.histogram(col(spark, [3.0] * 5), "x", n=100)
    assert rows(h, "bin", "cnt") == [(0, 5)]


def test_null_and_nan_excluded(spark):
    h = S.histogram(col(spark, [1.0, None, float("nan"), 2.0]), "x", n=10)
    assert sum(c for _, c in rows(h, "bin", "cnt")) == 2


def test_below_quantile(spark):
    h = S.histogram(col(spark, [float(v) for v in range(1, 11)]), "x", n=100,
                    anchor="quantile", q=0.8)
    got = rows(h, "bin", "cnt", "hi", "lo")
    assert {r[2] for r in got} == {8.0} and {r[3] for r in got} == {1.0}
    assert sum(r[1] for r in got) == 7
    assert all(r[0] < 0 for r in got)
    assert [r[0] for r in got] == [-100, -86, -72, -58, -43, -29, -15]


def test_zero_bin_and_right_closed(spark):
    h = S.histogram(col(spark, [0.0, 0.0, 1.0, 2.0, 10.0]), "x", n=10, zero_bin=True)
    # width = (10 - 0) / 10 = 1; (0,1] -> 0, (1,2] -> 1, (9,10] -> 9
    assert rows(h, "bin", "cnt") == [(-1, 2), (0, 1), (1, 1), (9, 1)]


def test_unit_width(spark):
    h = S.histogram(col(spark, [1.2, 1.9, 2.0, -0.5]), "x", unit_width=True)
    assert rows(h, "bin", "cnt") == [(-1, 1), (1, 2), (2, 1)]


def test_by_slice_and_counts_sum(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("b", 5.0), ("b", 5.0)],
                               "s string, x double")
    h = S.histogram(df, "x", n=10, by=["s"])
    got = rows(h, "s", "bin", "cnt")
    assert [r for r in got if r[0] == "b"] == [("b", 0, 2)]
    assert sum(r[2] for r in got if r[0] == "a") == 11
    assert [r[1] for r in got if r[0] == "a"] == list(range(11))


def test_histogram_string_and_undefined(spark):
    h = S.histogram(col(spark, [0.0, 50.0, 100.0]), "x", n=100)
    assert S.histogram_string(h).first().bins == "0:1,50:1,100:1"
    u = S.undefined_count(col(spark, [1.0, None, float("nan")]), "x").first()
    assert u.n_undefined == 2


def test_filter_by_quantile_keeps_ties(spark):
    df = col(spark, [1.0, 2.0, 2.0, 2.0, 3.0])
    assert S.filter_by_quantile(df, "x", 0.5).count() == 4
    assert S.filter_by_quantile(df, "x", 0.5, strict=True).count() == 1


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        S.histogram(col(spark, [1.0]), "x", n=0)

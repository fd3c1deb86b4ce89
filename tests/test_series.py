import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.operators import rank
from casewise.operators import series as ts


def months(n, start=2011):
    return [datetime.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def make(spark, values, name="s"):
    rows = [(name, m, i + 1, float(v)) for i, (m, v) in enumerate(zip(months(len(values)), values))]
    return spark.createDataFrame(rows, "series string, month date, t long, value double")


def test_calendar_fills_gaps(spark):
    rows = [("s", months(4)[0], 5.0), ("s", months(4)[3], 7.0)]
    got = ts.regular_series(spark.createDataFrame(rows, "series string, month date, value double"), "series", "month", "value")
    assert [(r["t"], r["value"]) for r in got.orderBy("t").collect()] == [(1, 5.0), (2, 0.0), (3, 0.0), (4, 7.0)]


def test_exponential_smoothing(spark):
    got = ts.exponential_smoothing(make(spark, [10, 20, 30]), "series", "t", "value", [0.5]).orderBy("t").collect()
    assert [r["fitted"] for r in got] == [None, 10.0, 15.0]
    sse = ts.smoothing_error(ts.exponential_smoothing(make(spark, [10, 20, 30]), "series", "t", "value", [0.5]), "series", "value")
    assert sse.first()["sse"] == 100.0 + 225.0


def test_trend_season_recovers_an_exact_model(spark):
    effects = np.arange(12) * 3.0
    values = [100 + 2.5 * (i + 1) + effects[i % 12] for i in range(48)]
    points = make(spark, values)
    marked = ts.holdout_last_k(points, "series", "t", 6)
    out = ts.trend_season_forecast(marked, "series", "month", "t", "value", F.col("is_train"))
    assert out.select(F.max(F.abs(F.col("value") - F.col("forecast")))).first()[0] < 1e-9
    known = F.col("value").isNotNull()
    longer = ts.regular_series(points, "series", "month", "value", ahead=6)
    ahead = ts.trend_season_forecast(longer, "series", "month", "t", "value", known).where(~known).orderBy("t").collect()
    assert [r["t"] for r in ahead] == list(range(49, 55)) and abs(ahead[0]["forecast"] - (100 + 2.5 * 49)) < 1e-9


def test_residuals_sum_to_zero_per_month(spark):
    df = make(spark, np.random.default_rng(2).normal(size=50))
    out = ts.trend_season_forecast(df, "series", "month", "t", "value", F.lit(True))
    sums = out.groupBy(F.month("month")).agg(F.sum(F.col("value") - F.col("forecast")).alias("s")).collect()
    assert max(abs(r["s"]) for r in sums) < 1e-9


def test_short_series_has_no_slope(spark):
    out = ts.trend_season_forecast(make(spark, range(10)), "series", "month", "t", "value", F.lit(True))
    assert out.where("forecast IS NOT NULL").count() == 0


def test_accuracy_skips_zero_actuals(spark):
    df = spark.createDataFrame([("s", 0.0, 1.0), ("s", 2.0, 1.0)], "series string, a double, f double")
    r = ts.forecast_accuracy(df, "a", "f", ["series"]).first()
    assert (r["me"], r["mae"], r["rmse"], r["mape"]) == (0.0, 1.0, 1.0, 50.0)


def test_acf_pacf_ljung_box(spark):
    x = np.random.default_rng(1).normal(size=60).cumsum()
    corr = ts.acf(make(spark, x), "series", "t", "value", 6)
    c = x - x.mean()
    want = [float((c[: len(c) - k] * c[k:]).sum() / (c * c).sum()) for k in range(7)]
    assert np.allclose([r["acf"] for r in corr.orderBy("lag").collect()], want)
    partial = [r["pacf"] for r in ts.pacf(corr, "series").orderBy("lag").collect()]
    for k in range(1, 7):
        toeplitz = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(np.linalg.solve(toeplitz, np.array(want[1 : k + 1]))[-1] - partial[k - 1]) < 1e-9
    q = ts.ljung_box(corr, "series").first()["statistic"]
    assert abs(q - 60 * 62 * sum(want[k] ** 2 / (60 - k) for k in range(1, 7))) < 1e-9


def test_seasonal_ar_follows_its_recursion(spark):
    d, x = 5.0, list(range(12))
    for i in range(36):
        x.append(x[i] + d)
        d = 1.0 + 0.5 * d
    df = make(spark, x)
    model = ts.seasonal_ar_forecast(df, "series", "month", "t", "value", 1).first()
    assert abs(model["c"] - 1.0) < 1e-6 and abs(model["phi"] - 0.5) < 1e-6
    got = [r["forecast"] for r in ts.seasonal_ar_forecast(df, "series", "month", "t", "value", 3).orderBy("t").collect()]
    want = []
    for h in range(3):
        want.append(x[36 + h] + d)
        d = 1.0 + 0.5 * d
    assert np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("width, first, last", [(4, 2, 8), (5, 3, 8), (3, 2, 9)])
def test_moving_average_frames(spark, width, first, last):
    got = rank.moving_average(make(spark, range(10)), "series", "t", "value", width).where("smoothed IS NOT NULL")
    assert got.agg(F.min("t"), F.max("t")).first()[:] == (first, last)


def test_edges_are_straight_lines(spark):
    values = [float(v) for v in [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]]
    smooth = rank.moving_average(make(spark, values), "series", "t", "value", 3)
    before = {r["t"]: r["smoothed"] for r in smooth.collect()}
    after = {r["t"]: r["smoothed"] for r in rank.edge_extrapolation(smooth, "series", "t", "smoothed", 3).collect()}
    left, right = before[5] - before[4], before[9] - before[8]
    assert np.allclose([after[t] for t in (1, 2, 3)], [before[4] - left * k for k in (3, 2, 1)])
    assert np.allclose([after[t] for t in (10, 11, 12)], [before[9] + right * k for k in (1, 2, 3)])
    short = rank.edge_extrapolation(rank.moving_average(make(spark, range(7)), "series", "t", "value", 3), "series", "t", "smoothed", 3)
    assert short.where("t <= 3 AND smoothed IS NOT NULL").count() == 0

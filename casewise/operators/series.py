"""Monthly time series, all series in parallel.

Inputs are already reduced to one row per (series, month), so a series is as long as its calendar
and windows partitioned by series stay small whatever the number of source rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SEASON = 12


def regular_series(df: DataFrame, series: str, month: str, value: str, fill: float = 0.0, ahead: int = 0) -> DataFrame:
    """Gap-free calendar per series with index t = 1..n; missing months get ``fill``.

    ``ahead`` adds that many months after the last one, with a NULL value. The input has one row per
    (series, month), so a series packs into one map no longer than its calendar and needs no join.
    Rows without a month have no place in a calendar; ``undated_rows`` counts them.
    """
    step = F.make_ym_interval(months=F.lit(1))
    packed = df.where(F.col(month).isNotNull()).groupBy(series).agg(
        F.min(month).alias("_from"), F.max(month).alias("_to"),
        F.map_from_entries(F.collect_list(F.struct(month, value))).alias("_have"),
    )
    until = F.add_months("_to", ahead)
    points = packed.select(series, "_to", "_have", F.posexplode(F.sequence("_from", until, step)).alias("_i", month))
    known = F.when(F.col(month) <= F.col("_to"), F.coalesce(F.try_element_at("_have", F.col(month)), F.lit(fill)))
    return points.select(series, month, (F.col("_i") + 1).cast("long").alias("t"), known.alias(value))


def undated_rows(df: DataFrame, series: str, month: str) -> DataFrame:
    """Rows per series whose month is missing; series without such rows are absent."""
    return df.where(F.col(month).isNull()).groupBy(series).agg(F.count(F.lit(1)).alias("rows"))


def exponential_smoothing(df: DataFrame, series: str, t: str, value: str, alphas: Sequence[float]) -> DataFrame:
    """One-step-ahead level per point and smoothing constant; NULL for the first point of a series.

    Each series is packed once and folded for every constant.
    """
    points = F.transform(F.array_sort(F.collect_list(F.struct(t, value))), lambda p: p[value])
    start = F.struct(F.get("_x", 0).alias("level"), F.array(F.lit(None).cast("double")).alias("fitted"))
    alpha = F.col("alpha")

    def step(state, x):
        return F.struct(
            (x * alpha + state["level"] * (1 - alpha)).alias("level"),
            F.array_append(state["fitted"], state["level"]).alias("fitted"),
        )

    packed = df.groupBy(series).agg(points.alias("_x"))
    tried = packed.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    folded = tried.withColumn("_f", F.aggregate(F.slice("_x", 2, F.size("_x")), start, step)["fitted"])
    return folded.select(series, "alpha", F.posexplode(F.arrays_zip("_x", "_f")).alias("_i", "_p")).select(
        series, "alpha", (F.col("_i") + 1).cast("long").alias(t), F.col("_p._x").alias(value), F.col("_p._f").alias("fitted")
    )


def smoothing_error(fitted: DataFrame, series: str, value: str) -> DataFrame:
    """Sum of squared one-step errors per series and smoothing constant."""
    gap = F.col(value) - F.col("fitted")
    return fitted.groupBy(series, "alpha").agg(F.sum(gap * gap).alias("sse"))


def holdout_last_k(df: DataFrame, series: str, t: str, k: int) -> DataFrame:
    """Mark all but the last ``k`` points of each series as training rows."""
    n = F.max(t).over(W.partitionBy(series))
    return df.withColumn("is_train", F.col(t) <= n - k)


def trend_season_forecast(df: DataFrame, series: str, month: str, t: str, value: str, train: Column) -> DataFrame:
    """Linear trend plus one effect per calendar month, fitted on the ``train`` rows of each series.

    Adds ``trend``, ``effect`` and ``forecast`` to every row, so fitted values, held-out months and
    months ahead come from the same pass. The trend is the slope within calendar months; a month not
    seen in training, or a series without two points in any month, gets NULL.
    """
    whole, season = W.partitionBy(series), W.partitionBy(series, F.month(month))
    x, y = F.when(train, F.col(t)), F.when(train, F.col(value))
    cells = df.withColumns({"_x": x, "_y": y}).withColumns({"_mx": F.avg("_x").over(season), "_my": F.avg("_y").over(season)})
    away = F.col("_x") - F.col("_mx")
    cross, square = F.sum(away * (F.col("_y") - F.col("_my"))).over(whole), F.sum(away * away).over(whole)
    fitted = cells.withColumn("trend", F.try_divide(cross, square))
    fitted = fitted.withColumn("effect", F.col("_my") - F.col("trend") * F.col("_mx"))
    return fitted.withColumn("forecast", F.col("effect") + F.col("trend") * F.col(t)).drop("_x", "_y", "_mx", "_my")


def forecast_accuracy(df: DataFrame, actual: str, forecast: str, by: Sequence[str]) -> DataFrame:
    """ME, RMSE, MAE, MPE and MAPE; zero actuals are left out of the percentages."""
    error = F.col(actual) - F.col(forecast)
    relative = F.try_divide(error, F.col(actual)) * 100
    return df.where(error.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error).alias("me"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(relative).alias("mpe"),
        F.avg(F.abs(relative)).alias("mape"),
    )


def acf(df: DataFrame, series: str, t: str, value: str, max_lag: int) -> DataFrame:
    """Autocorrelation at lags 0..max_lag with the full-series mean and denominator."""
    whole = W.partitionBy(series)
    ordered = whole.orderBy(t)
    centred = df.select(series, t, (F.col(value) - F.avg(value).over(whole)).alias("_x"))
    lags = range(max_lag + 1)
    products = centred.select(series, *[(F.col("_x") * F.lag("_x", k).over(ordered)).alias(f"_p{k}") for k in lags])
    sums = [F.struct(F.lit(k).alias("lag"), F.sum(f"_p{k}").alias("s"), F.count(f"_p{k}").alias("n")) for k in lags]
    one = products.groupBy(series).agg(F.array(*sums).alias("_l"), F.sum("_p0").alias("_zero"))
    return (
        one.select(series, "_zero", F.explode("_l").alias("_k"))
        .select(series, "_k.lag", "_k.n", F.try_divide(F.col("_k.s"), F.col("_zero")).alias("acf"))
        .where(F.col("n") > 0)
    )


def pacf(correlations: DataFrame, series: str) -> DataFrame:
    """Partial autocorrelation from an ACF table by the Durbin-Levinson recursion.

    One short array per series (a number per lag) is folded with array functions.
    """
    rho = F.col("_rho")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def step(state, k):
        phi, known = state["phi"], F.slice(rho, F.lit(2), k - 1)
        top = F.get(rho, k) - dot(phi, F.reverse(known))
        last = F.try_divide(top, 1 - dot(phi, known))
        turned = F.zip_with(phi, F.reverse(phi), lambda x, y: x - last * y)
        return F.struct(F.array_append(turned, last).alias("phi"), F.array_append(state["out"], last).alias("out"))

    empty = F.array().cast("array<double>")
    folded = F.aggregate(F.sequence(F.lit(1), F.size(rho) - 1), F.struct(empty.alias("phi"), empty.alias("out")), step)["out"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda p: p["acf"])
    packed = correlations.groupBy(series).agg(ordered.alias("_rho")).where(F.size("_rho") > 1)
    return packed.select(series, F.posexplode(folded).alias("_i", "pacf")).select(series, (F.col("_i") + 1).alias("lag"), "pacf")


def ljung_box(correlations: DataFrame, series: str) -> DataFrame:
    """Portmanteau statistic over all lags of an ACF table (``n`` pairs at a lag are length less lag)."""
    part = F.when(F.col("lag") > 0, F.col("acf") * F.col("acf") / F.col("n"))
    length = F.max(F.col("n") + F.col("lag"))
    return correlations.groupBy(series).agg(
        F.max("lag").alias("lags"), (length * (length + 2) * F.sum(part)).alias("statistic")
    )


def seasonal_ar_forecast(df: DataFrame, series: str, month: str, t: str, value: str, steps: int) -> DataFrame:
    """Regress the seasonal difference on its previous value and iterate ``steps`` months ahead.

    Returns (series, month, t, c, phi, forecast); ``steps`` is at most one season. Series without a
    full season and a point before it have no forecast.
    """
    if not 1 <= steps <= SEASON:
        raise ValueError("steps must lie within one season")
    ordered = W.partitionBy(series).orderBy(t)
    diffs = df.withColumn("_d", F.col(value) - F.lag(value, SEASON).over(ordered))
    pairs = diffs.withColumn("_p", F.lag("_d").over(ordered))
    values = F.transform(F.array_sort(F.collect_list(F.struct(t, value))), lambda p: p[value])
    # One season back and the last difference are all the recursion needs.
    packed = pairs.groupBy(series).agg(
        F.regr_intercept("_d", "_p").alias("c"), F.regr_slope("_d", "_p").alias("phi"),
        F.slice(values, -(SEASON + 1), SEASON + 1).alias("_x"), F.max(t).alias("_t"), F.max(month).alias("_m"),
    ).where(F.size("_x") == SEASON + 1)

    def step(state, h):
        d = F.col("c") + F.col("phi") * state["d"]
        return F.struct(d.alias("d"), F.array_append(state["out"], d + F.get("_x", h)).alias("out"))

    first = F.struct((F.get("_x", SEASON) - F.get("_x", 0)).alias("d"), F.array().cast("array<double>").alias("out"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)["out"]
    ahead = packed.select(series, "_t", "_m", "c", "phi", F.posexplode(path).alias("_h", "forecast"))
    return ahead.where(F.col("forecast").isNotNull()).select(
        series, F.add_months("_m", F.col("_h") + 1).alias(month), (F.col("_t") + F.col("_h") + 1).alias(t), "c", "phi", "forecast"
    )

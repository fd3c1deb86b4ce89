"""Registered queries: monthly time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.operators import arma, rank
from casewise.operators import series as ts
from casewise.plans import lenses as lens
from casewise.plans.lens_sql import LENS_SQL
from casewise.plans.registry import query
from casewise.plans.shape import tidy

SERIES = "retail monthly series"
HOLDOUT = 6
# The smoothing constants tried in the case study.
ALPHAS = (0.2, 0.99, 0.56, 0.3)

FIT_SQL = """
    WITH sized AS (SELECT *, month(month) AS season, count(*) OVER (PARTITION BY series) AS n FROM series),
    train AS (SELECT series, season, t, value FROM sized WHERE t <= n - 6),
    cell AS (SELECT series, season, avg(t) AS mt, avg(value) AS my FROM train GROUP BY ALL),
    slope AS (SELECT series, sum((t - mt) * (value - my)) / nullif(sum((t - mt) * (t - mt)), 0) AS b
              FROM train JOIN cell USING (series, season) GROUP BY series),
    model AS (SELECT series, season, b, my - b * mt AS a FROM cell JOIN slope USING (series)),
    fitted AS (SELECT series, month, t, n, value, a + b * t AS forecast FROM sized LEFT JOIN model USING (series, season)),
    resid AS (SELECT series, t, value - forecast AS e FROM fitted WHERE t <= n - 6),
    centred AS (SELECT series, t, e - avg(e) OVER (PARTITION BY series) AS x FROM resid),
    acf AS (SELECT series, k AS lag, count(*) AS pairs, sum(a.x * b.x) / max(z) AS acf, max(n) AS n
            FROM centred a JOIN (SELECT unnest(range(13)) AS k) ON true
            JOIN centred b USING (series) JOIN (SELECT series, sum(x * x) AS z, count(*) AS n FROM centred GROUP BY series) USING (series)
            WHERE b.t = a.t + k GROUP BY series, k)
"""


def _fitted(marked):
    return ts.trend_season_forecast(marked, "series", "month", "t", "value", F.col("is_train"))


def _parts(spark, folder):
    """All points with the forecast of the model fitted on all but the last six."""
    return _fitted(ts.holdout_last_k(lens.series(spark, folder), "series", "t", HOLDOUT))


def _residual_acf(spark, folder):
    train = _parts(spark, folder).where("is_train")
    return ts.acf(train.withColumn("e", F.col("value") - F.col("forecast")), "series", "t", "e", 12)


@query("regular_series", SERIES, "SELECT series, month, t, round(value, 4) AS value FROM series")
def _(spark, folder):
    return tidy(lens.series(spark, folder), 4)


SES_SQL = """
    WITH RECURSIVE run AS (
        SELECT series, t, alpha, value, NULL::DOUBLE AS fitted, value AS level FROM series, (SELECT unnest([0.2, 0.99, 0.56, 0.3]::DOUBLE[]) AS alpha) WHERE t = 1
        UNION ALL
        SELECT s.series, s.t, r.alpha, s.value, r.level, r.alpha * s.value + (1 - r.alpha) * r.level
        FROM run r JOIN series s ON s.series = r.series AND s.t = r.t + 1)
"""


def _smoothed(spark, folder):
    return ts.exponential_smoothing(lens.series(spark, folder), "series", "t", "value", ALPHAS)


@query("exponential_smoothing", SERIES, SES_SQL + "SELECT series, t, alpha, round(fitted, 3) AS fitted FROM run")
def _(spark, folder):
    return tidy(_smoothed(spark, folder).select("series", "t", "alpha", "fitted"), 3)


@query("smoothing_error", SERIES, SES_SQL + """
    SELECT series, alpha, round(sum((value - fitted) * (value - fitted)) / 1e10, 6) AS sse FROM run GROUP BY series, alpha""")
def _(spark, folder):
    errors = ts.smoothing_error(_smoothed(spark, folder), "series", "value")
    return tidy(errors.withColumn("sse", F.col("sse") / 1e10))


@query("holdout_last_k", SERIES, """
    SELECT series, t, round(value, 4) AS value, t <= count(*) OVER (PARTITION BY series) - 6 AS is_train FROM series""")
def _(spark, folder):
    return tidy(ts.holdout_last_k(lens.series(spark, folder), "series", "t", HOLDOUT).drop("month"), 4)


@query("trend_season_forecast", SERIES, FIT_SQL + "SELECT series, month, t, round(forecast, 3) AS forecast FROM fitted")
def _(spark, folder):
    return tidy(_parts(spark, folder).select("series", "month", "t", "forecast"), 3)


@query("trend_season_ahead", SERIES, FIT_SQL.replace("t <= n - 6", "t <= n") + """
    SELECT series, CAST(m + to_months(CAST(h AS INTEGER)) AS DATE) AS month, last + h AS t, round(a + b * (last + h), 3) AS forecast
    FROM (SELECT series, max(month) AS m, max(t) AS last FROM series GROUP BY series) JOIN model USING (series),
         (SELECT unnest(range(1, 7)) AS h) WHERE model.season = month(m + to_months(CAST(h AS INTEGER)))""")
def _(spark, folder):
    points = lens.series(spark, folder, ahead=HOLDOUT)
    known = F.col("value").isNotNull()
    ahead = ts.trend_season_forecast(points, "series", "month", "t", "value", known).where(~known)
    return tidy(ahead.select("series", "month", "t", "forecast"), 3)


ACCURACY_SQL = """
    SELECT series, count(*) AS n, round(avg(e), 3) AS me, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae,
           round(avg(e / nullif(value, 0) * 100), 4) AS mpe, round(avg(abs(e / nullif(value, 0) * 100)), 4) AS mape
    FROM (SELECT *, value - forecast AS e FROM {points}) GROUP BY series"""


def _accuracy(points):
    scores = ts.forecast_accuracy(points, "value", "forecast", ["series"])
    return scores.withColumns({
        **{c: F.round(c, 3) for c in ("me", "rmse", "mae")}, **{c: F.round(c, 4) for c in ("mpe", "mape")},
    })


@query("forecast_accuracy", SERIES, FIT_SQL + ACCURACY_SQL.format(points="fitted WHERE t > n - 6"))
def _(spark, folder):
    return _accuracy(_parts(spark, folder).where(~F.col("is_train")))


@query("acf", SERIES, FIT_SQL + "SELECT series, lag, pairs AS n, round(acf, 6) AS acf FROM acf")
def _(spark, folder):
    return tidy(_residual_acf(spark, folder))


@query("pacf", SERIES, FIT_SQL.replace("WITH sized", "WITH RECURSIVE sized").rstrip() + """,
    rho AS (SELECT series, list(acf ORDER BY lag) AS r FROM acf WHERE lag > 0 GROUP BY series),
    run AS (SELECT series, 1 AS k, r, [r[1]] AS phi, r[1] AS last FROM rho
            UNION ALL
            SELECT series, k + 1, r, list_append(list_transform(phi, lambda x, i: x - nxt * phi[k + 1 - i]), nxt), nxt
            FROM (SELECT *, (r[k + 1] - list_sum(list_transform(phi, lambda x, i: x * r[k + 1 - i])))
                            / (1 - list_sum(list_transform(phi, lambda x, i: x * r[i]))) AS nxt FROM run WHERE k < 12))
    SELECT series, k::BIGINT AS lag, round(last, 6) AS pacf FROM run""")
def _(spark, folder):
    return tidy(ts.pacf(_residual_acf(spark, folder), "series"))


@query("ljung_box", SERIES, FIT_SQL + """
    SELECT series, max(lag) AS lags, round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 4) AS statistic
    FROM acf WHERE lag > 0 GROUP BY series""")
def _(spark, folder):
    return tidy(ts.ljung_box(_residual_acf(spark, folder), "series"), 4)


AR_SQL = """
    WITH RECURSIVE diffs AS (SELECT series, t, value, value - lag(value, 12) OVER (PARTITION BY series ORDER BY t) AS d FROM {train}),
    pairs AS (SELECT *, lag(d) OVER (PARTITION BY series ORDER BY t) AS p FROM diffs),
    model AS (SELECT series, regr_intercept(d, p) AS c, regr_slope(d, p) AS phi FROM pairs WHERE d IS NOT NULL AND p IS NOT NULL GROUP BY series),
    ends AS (SELECT series, max(t) AS last, max(month) AS m FROM {train} GROUP BY series),
    path AS (SELECT series, 0 AS h, d FROM diffs JOIN ends USING (series) WHERE t = last
             UNION ALL SELECT series, h + 1, c + phi * d FROM path JOIN model USING (series) WHERE h < 6),
    ahead AS (SELECT series, last + h AS t, CAST(m + to_months(h) AS DATE) AS month, d + x.value AS forecast
              FROM path JOIN ends USING (series) JOIN {train} x USING (series) WHERE h > 0 AND x.t = last + h - 12)
"""


@query("seasonal_ar_forecast", SERIES, AR_SQL.format(train="series") + "SELECT series, month, t, round(forecast, 3) AS forecast FROM ahead")
def _(spark, folder):
    ahead = ts.seasonal_ar_forecast(lens.series(spark, folder), "series", "month", "t", "value", HOLDOUT)
    return tidy(ahead.drop("c", "phi"), 3)


@query("seasonal_ar_accuracy", SERIES, AR_SQL.format(train="train").replace(
    "WITH RECURSIVE", "WITH RECURSIVE train AS (SELECT series, month, t, value FROM series QUALIFY t <= count(*) OVER (PARTITION BY series) - 6),"
    ) + ACCURACY_SQL.format(points="(SELECT series, value, forecast FROM ahead JOIN series USING (series, t))"))
def _(spark, folder):
    marked = ts.holdout_last_k(lens.series(spark, folder), "series", "t", HOLDOUT)
    ahead = ts.seasonal_ar_forecast(marked.where("is_train"), "series", "month", "t", "value", HOLDOUT)
    return _accuracy(marked.where(~F.col("is_train")).join(ahead.drop("month"), ["series", "t"]))


# ARMA(1, 1) of the seasonal difference by two regressions on two regressors each, in closed form.
TWO_SQL = """
    {name} AS (SELECT series, avg({y}) - b1 * avg({a}) - b2 * avg({b}) AS b0, any_value(b1) AS b1, any_value(b2) AS b2 FROM {rows} JOIN (
        SELECT series, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS b1, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS b2 FROM (
            SELECT series, var_pop({a}) AS aa, var_pop({b}) AS bb, covar_pop({a}, {b}) AS ab, covar_pop({a}, {y}) AS ay, covar_pop({b}, {y}) AS yb
            FROM {rows} WHERE {y} + {a} + {b} IS NOT NULL GROUP BY series)) USING (series) WHERE {y} + {a} + {b} IS NOT NULL GROUP BY series, b1, b2)"""
ARMA_SQL = """
    WITH RECURSIVE diffs AS (SELECT series, month, t, value, value - lag(value, 12) OVER (PARTITION BY series ORDER BY t) AS d FROM series),
    lags AS (SELECT *, lag(d) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM diffs WINDOW w AS (PARTITION BY series ORDER BY t)),
    """ + TWO_SQL.format(name="long", rows="lags", y="d", a="d1", b="d2") + """,
    shocks AS (SELECT lags.*, d - (b0 + b1 * d1 + b2 * d2) AS e FROM lags LEFT JOIN long USING (series)),
    past AS (SELECT *, lag(e) OVER (PARTITION BY series ORDER BY t) AS e1 FROM shocks),
    """ + TWO_SQL.format(name="model", rows="past", y="d", a="d1", b="e1") + """,
    ends AS (SELECT series, max(t) AS last, max(month) AS m FROM series GROUP BY series),
    path AS (SELECT series, 0 AS h, d, e FROM shocks JOIN ends USING (series) WHERE t = last
             UNION ALL SELECT series, h + 1, b0 + b1 * d + b2 * e, 0.0::DOUBLE FROM path JOIN model USING (series) WHERE h < 6)
    SELECT series, CAST(m + to_months(h) AS DATE) AS month, last + h AS t, round(d + x.value, 2) + 0.0 AS forecast
    FROM path JOIN ends USING (series) JOIN series x USING (series)
    JOIN model USING (series) WHERE h > 0 AND x.t = last + h - 12 AND abs(b1) < 0.99 AND abs(b2) < 0.99"""


@query("arma_forecast", SERIES, ARMA_SQL)
def _(spark, folder):
    """One order, fitted and iterated six months ahead."""
    ahead = arma.search_forecast(lens.series(spark, folder), "series", "month", "t", "value", HOLDOUT, 1, 1, long=2, only=(1, 1))
    return tidy(ahead.drop("p", "q"), 2)


@query("arma_order_search")
def _(spark, folder):
    """Every order up to (2, 2) of every series, with its AIC."""
    models = arma.search_orders(arma.shocks(lens.series(spark, folder), "series", "t", "value"), "series", "t")
    return tidy(models.select("series", "p", "q", "n", "aicc", "chosen"), 4)


@query("arma_search_accuracy")
def _(spark, folder):
    """Held-out errors of the chosen orders; to compare with ``seasonal_ar_accuracy``."""
    marked = ts.holdout_last_k(lens.series(spark, folder), "series", "t", HOLDOUT)
    ahead = arma.search_forecast(marked.where("is_train"), "series", "month", "t", "value", HOLDOUT)
    return _accuracy(marked.where(~F.col("is_train")).join(ahead.drop("month"), ["series", "t"]))


QUANTITY_SQL = f"""
    WITH monthly AS ({LENS_SQL["monthly"].replace("sum(sales)", "sum(quantity)")}),
    series AS ({LENS_SQL["series"]}),
    """ + FIT_SQL.strip().removeprefix("WITH ")


@query("quantity_accuracy", "retail", QUANTITY_SQL + ACCURACY_SQL.format(points="fitted WHERE t > n - 6"))
def _(spark, folder):
    """The same model on the monthly quantity."""
    points = lens.series(spark, folder, measure="quantity")
    return _accuracy(_fitted(ts.holdout_last_k(points, "series", "t", HOLDOUT)).where(~F.col("is_train")))


@query("smoothed_accuracy", SERIES, """
    WITH smooth AS (SELECT series, month, t, CASE WHEN count(*) OVER f = 4 THEN avg(value) OVER f END AS s,
                           count(*) OVER (PARTITION BY series) AS n FROM series
                    WINDOW f AS (PARTITION BY series ORDER BY t ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)),
    anchor AS (SELECT *, max(s) FILTER (t = 5) OVER w AS l0, max(s) FILTER (t = 6) OVER w AS l1,
                      max(s) FILTER (t = n - 4) OVER w AS r0, max(s) FILTER (t = n - 5) OVER w AS r1 FROM smooth WINDOW w AS (PARTITION BY series)),
    series2 AS (SELECT series, month, t, CASE WHEN t <= 4 THEN l0 - (5 - t) * (l1 - l0) WHEN t > n - 4 THEN r0 + (t - n + 4) * (r0 - r1) ELSE s END AS value FROM anchor),
    """ + FIT_SQL.strip().removeprefix("WITH ").replace("FROM series)", "FROM series2)") + ACCURACY_SQL.format(points="fitted WHERE t > n - 6"))
def _(spark, folder):
    smooth = rank.moving_average(lens.series(spark, folder), "series", "t", "value", 4)
    smooth = rank.edge_extrapolation(smooth, "series", "t", "smoothed", 4)
    points = smooth.select("series", "month", "t", F.col("smoothed").alias("value"))
    marked = _fitted(ts.holdout_last_k(points, "series", "t", HOLDOUT))
    return _accuracy(marked.where(~F.col("is_train")))

"""Automatic order search for monthly series, all series at once, by two regressions.

The seasonal difference of a series is modelled as ARMA(p, q). A long autoregression gives estimates of the shocks; the difference is then regressed on its own
past and on past shocks, for every order up to the given ones on the same rows, and the order with the least corrected AIC is kept. Both
regressions need only each series' cross products: rows are reduced to one row of sums per series by Spark, and the small solves run on that
table, many series at a time. Forecasts iterate with array functions.

A series needs enough points for the rows of the second regression; otherwise it has no model and no forecast. Missing values leave out the rows they
touch. A regressor that others determine gets the coefficients of least size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from casewise.operators.order import join_same
from casewise.operators.series import SEASON

LONG = 2
# Roots of a model that may be chosen.
INSIDE = 0.99


def _cross_products(rows: DataFrame, series: str, names: Sequence[str]) -> DataFrame:
    """Per series the sums of all products of ``names`` over complete rows, as one array, row by row."""
    complete = rows.dropna(subset=list(names))
    sums = [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    return complete.groupBy(series).agg(F.array(*sums).alias("sums"))


def _solve(cross: np.ndarray, wanted: list[int], target: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual sums of the regressions of ``target`` on ``wanted`` for a stack of cross products."""
    gram, right = cross[:, wanted][:, :, wanted], cross[:, wanted, target]
    scale = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 0.0))
    scale[scale == 0] = 1.0
    inverse = np.linalg.pinv(gram / (scale[:, :, None] * scale[:, None, :]), rcond=1e-12, hermitian=True)
    b = np.einsum("sij,sj->si", inverse, right / scale) / scale
    return b, np.maximum(cross[:, target, target] - np.einsum("si,si->s", b, right), 0.0)


def _settles(phi: np.ndarray) -> np.ndarray:
    """Whether each recursion ``x = phi[0] * x1 + phi[1] * x2 + ...`` dies out: all roots of its companion matrix lie inside ``INSIDE``."""
    size = phi.shape[1]
    if not size:
        return np.ones(len(phi), bool)
    companion = np.zeros((len(phi), size, size))
    companion[:, 0] = phi
    companion[:, range(1, size), range(size - 1)] = 1.0
    return np.abs(np.linalg.eigvals(companion)).max(axis=1) < INSIDE


def shocks(points: DataFrame, series: str, t: str, value: str, long: int = LONG) -> DataFrame:
    """Adds the seasonal difference ``d`` and the shock ``e``: what a long autoregression leaves of it."""
    ordered = W.partitionBy(series).orderBy(t)
    rows = points.select(series, t, value, (F.col(value) - F.lag(value, SEASON).over(ordered)).alias("d")).withColumn("one", F.lit(1.0))
    rows = rows.withColumns({f"d{k}": F.lag("d", k).over(ordered) for k in range(1, long + 1)})
    names = ["one", *[f"d{k}" for k in range(1, long + 1)], "d"]
    size = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                b, _ = _solve(np.stack(batch["sums"].to_numpy()).reshape(-1, size, size), list(range(size - 1)), size - 1)
                yield pd.DataFrame({series: batch[series], "ar": list(b)})

    schema = f"`{series}` {points.schema[series].dataType.simpleString()}, ar array<double>"
    fitted = _cross_products(rows, series, names).mapInPandas(solve, schema)
    known = sum((F.get("ar", k) * F.col(n) for k, n in enumerate(names[1:-1], 1)), F.get("ar", 0))
    return join_same(rows, fitted, [series]).select(series, t, value, "d", (F.col("d") - known).alias("e"))


def search_orders(shocked: DataFrame, series: str, t: str, p: int = 2, q: int = 2, only: tuple[int, int] | None = None) -> DataFrame:
    """One row per series and order: ``p``, ``q``, rows ``n``, ``aicc``, ``c``, ``phi`` and ``theta`` (filled up with zeros) and ``chosen``.

    An order whose estimate would explode, in its own past or in its shocks, has no AIC and isn't chosen. All orders are compared on the same rows. Equal AICs go to the order with fewer terms, then to the smaller p.
    """
    ordered = W.partitionBy(series).orderBy(t)
    past = {f"d{k}": F.lag("d", k).over(ordered) for k in range(1, p + 1)} | {f"e{k}": F.lag("e", k).over(ordered) for k in range(1, q + 1)}
    rows = shocked.withColumn("one", F.lit(1.0)).withColumns(past)
    names = ["one", *past, "d"]
    size = len(names)
    orders = [only] if only else sorted(((a, b) for a in range(p + 1) for b in range(q + 1)), key=lambda o: (sum(o), o))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            cross = np.stack(batch["sums"].to_numpy()).reshape(-1, size, size)
            n, tables = cross[:, 0, 0], []
            for a, b in orders:
                wanted = [0, *range(1, a + 1), *range(p + 1, p + 1 + b)]
                found, rss = _solve(cross, wanted, size - 1)
                k = len(wanted) + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    aicc = np.where(n > k + 1, n * np.log(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1), np.nan)
                whole = np.zeros((len(n), 1 + p + q))
                whole[:, wanted] = found
                aicc[~(_settles(whole[:, 1 : a + 1]) & _settles(-whole[:, p + 1 : p + 1 + b]))] = np.nan
                tables.append(pd.DataFrame({series: batch[series], "p": a, "q": b, "n": n.astype(np.int64), "aicc": aicc, "c": whole[:, 0],
                                            "phi": list(whole[:, 1 : p + 1]), "theta": list(whole[:, p + 1 :])}))
            values = np.stack([x["aicc"].to_numpy() for x in tables])
            best = np.where(np.isnan(values).all(axis=0), -1, np.argmin(np.where(np.isnan(values), np.inf, values), axis=0))
            for i, table in enumerate(tables):
                table["chosen"] = best == i
                yield table

    schema = f"`{series}` {shocked.schema[series].dataType.simpleString()}, p int, q int, n long, aicc double, c double, phi array<double>, theta array<double>, chosen boolean"
    found = _cross_products(rows, series, names).mapInPandas(compare, schema)
    return found.withColumn("aicc", F.nanvl("aicc", F.lit(None).cast("double")))


def forecast(points: DataFrame, shocked: DataFrame, models: DataFrame, series: str, month: str, t: str, value: str, steps: int) -> DataFrame:
    """(series, month, t, p, q, forecast) for ``steps`` months, at most a season, after the last point, by each series' chosen model."""
    if not 1 <= steps <= SEASON:
        raise ValueError("steps must lie within one season")
    chosen = models.where("chosen")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(c).alias("x")))), lambda s: s["x"])
    ends = points.groupBy(series).agg(F.max(t).alias("_t"), F.max(month).alias("_m"))
    packed = shocked.groupBy(series).agg(listed(value).alias("_x"), listed("d").alias("_d"), listed("e").alias("_e"))
    rows = join_same(join_same(chosen, packed, [series]), ends, [series]).where(F.size("_x") > SEASON)
    back = lambda a, n: F.reverse(F.slice(a, -n, n))  # noqa: E731  the last ``n``, newest first
    width = lambda a: F.greatest(F.size(a), F.lit(1))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, h: Column) -> Column:
        d = F.col("c") + dot(F.col("phi"), F.slice(state["d"], F.lit(1), F.size("phi"))) + dot(F.col("theta"), F.slice(state["e"], F.lit(1), F.size("theta")))
        seasonal = F.get("_x", F.size("_x") - SEASON + h)
        return F.struct(F.concat(F.array(d), state["d"]).alias("d"), F.concat(F.array(F.lit(0.0)), state["e"]).alias("e"),
                        F.array_append(state["out"], d + seasonal).alias("out"))

    start = F.struct(back("_d", width("phi")).alias("d"), back("_e", width("theta")).alias("e"), F.array().cast("array<double>").alias("out"))
    ahead = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step)["out"]
    return rows.select(series, "p", "q", "_t", "_m", F.posexplode(ahead).alias("_i", "forecast")).select(
        series, F.add_months("_m", F.col("_i") + 1).alias(month), (F.col("_t") + F.col("_i") + 1).alias(t), "p", "q", "forecast")


def search_forecast(points: DataFrame, series: str, month: str, t: str, value: str, steps: int, p: int = 2, q: int = 2, long: int = LONG,
                    only: tuple[int, int] | None = None) -> DataFrame:
    """Search, fit and forecast; ``only`` fits that order alone."""
    shocked = shocks(points, series, t, value, long)
    return forecast(points, shocked, search_orders(shocked, series, t, p, q, only), series, month, t, value, steps)

"""Order search of monthly series against plain numpy."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.operators import arma

P = Q = 2


def simulate(n, phi, theta, seed):
    rng = np.random.default_rng(seed)
    d, e = np.zeros(n), rng.normal(size=n)
    for i in range(n):
        d[i] = 0.3 + sum(a * d[i - k] for k, a in enumerate(phi, 1) if i >= k) + e[i] + sum(b * e[i - k] for k, b in enumerate(theta, 1) if i >= k)
    x = np.concatenate([50 + 10 * np.sin(np.arange(12)), np.zeros(n)])
    for i in range(n):
        x[12 + i] = x[i] + d[i]
    return x


def frame(spark, series):
    month = lambda i: datetime.date(2000 + i // 12, i % 12 + 1, 1)
    return spark.createDataFrame([(s, month(i), i + 1, v if v is None else float(v)) for s, x in series.items() for i, v in enumerate(x)],
                                 "s string, m date, t long, v double").repartition(3)


def lagged(x, k):
    return np.concatenate([np.full(k, np.nan), x[: len(x) - k]])


def least(y, columns):
    a = np.column_stack([np.ones(len(y)), *columns])
    ok = np.isfinite(a).all(axis=1) & np.isfinite(y)
    b, *_ = np.linalg.lstsq(a[ok], y[ok], rcond=None)
    return a, ok, b


def plain(x, long=arma.LONG):
    """Orders with their AIC and estimate, and the shocks."""
    d = x - lagged(x, 12)
    a, ok, b = least(d, [lagged(d, k) for k in range(1, long + 1)])
    e = d - a @ b
    past = [lagged(d, k) for k in range(1, P + 1)] + [lagged(e, k) for k in range(1, Q + 1)]
    same = np.isfinite(np.column_stack([d, *past])).all(axis=1)
    out = {}
    for p in range(P + 1):
        for q in range(Q + 1):
            use = past[:p] + past[P : P + q]
            a, _, b = least(np.where(same, d, np.nan), use)
            n, k = same.sum(), 2 + p + q
            rss = ((d - a @ b)[same] ** 2).sum()
            roots = [np.abs(np.roots([1, *-b[1 : p + 1]])).max(initial=0), np.abs(np.roots([1, *b[p + 1 :]])).max(initial=0)]
            out[p, q] = (n * np.log(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1) if max(roots) < arma.INSIDE else None, b)
    return out, d, e


@pytest.fixture(scope="module")
def series(spark):
    some = {"ar": simulate(150, [0.7], [], 1), "ma": simulate(150, [], [0.8], 2), "both": simulate(150, [0.5, 0.2], [0.4], 3), "noise": simulate(60, [], [], 4),
            "walk": np.cumsum(np.random.default_rng(5).normal(size=90)) * 9}
    return some, frame(spark, some)


def test_every_order_equals_least_squares(series):
    some, given = series
    found = arma.search_orders(arma.shocks(given, "s", "t", "v"), "s", "t", P, Q).collect()
    assert len(found) == len(some) * (P + 1) * (Q + 1)
    for s, x in some.items():
        want, *_ = plain(x)
        rows = {(r.p, r.q): r for r in found if r.s == s}
        for order, (aicc, b) in want.items():
            r = rows[order]
            if aicc is None:
                assert r.aicc is None and not r.chosen
                continue
            assert r.aicc == pytest.approx(aicc, abs=1e-6)
            assert [r.c, *r.phi[: r.p], *r.theta[: r.q]] == pytest.approx(b.tolist(), abs=1e-6)
            assert not any(r.phi[r.p :]) and not any(r.theta[r.q :])
        best = min((o for o in want if want[o][0] is not None), key=lambda o: want[o][0])
        assert [o for o, r in rows.items() if r.chosen] == [best]
    assert {r.s: (r.p, r.q) for r in found if r.chosen}["ar"][0] >= 1 and {r.s: (r.p, r.q) for r in found if r.chosen}["ma"][1] >= 1


def test_forecasts_equal_the_recursion(series):
    some, given = series
    got = arma.search_forecast(given, "s", "m", "t", "v", 12, P, Q).collect()
    for s, x in some.items():
        want, d, e = plain(x)
        p, q = min((o for o in want if want[o][0] is not None), key=lambda o: want[o][0])
        b = want[p, q][1]
        d, e, x = list(d), list(e), list(x)
        for _ in range(12):
            d.append(b[0] + sum(b[k] * d[-k] for k in range(1, p + 1)) + sum(b[p + k] * e[-k] for k in range(1, q + 1)))
            e.append(0.0)
            x.append(d[-1] + x[-12])
        rows = sorted((r for r in got if r.s == s), key=lambda r: r.t)
        assert [r.forecast for r in rows] == pytest.approx(x[-12:], abs=1e-6)
        assert [r.t for r in rows] == list(range(len(x) - 11, len(x) + 1)) and {(r.p, r.q) for r in rows} == {(p, q)}


def test_short_constant_and_broken_series(spark):
    long = simulate(40, [0.4], [], 8)
    gap = [*long[:20], None, *long[21:]]
    given = frame(spark, {"short": [1.0] * 9, "year": [1.0] * 14, "flat": [3.0] * 60, "gap": gap})
    models = arma.search_orders(arma.shocks(given, "s", "t", "v"), "s", "t").where("chosen").collect()
    assert {r.s for r in models} >= {"gap"} and "short" not in {r.s for r in models} and "year" not in {r.s for r in models}
    ahead = arma.search_forecast(given, "s", "m", "t", "v", 3).collect()
    assert {r.s for r in ahead} <= {"gap", "flat"} and all(r.forecast == pytest.approx(3.0) for r in ahead if r.s == "flat")
    assert arma.search_forecast(given.limit(0), "s", "m", "t", "v", 3).count() == 0
    with pytest.raises(ValueError):
        arma.search_forecast(given, "s", "m", "t", "v", 13)


def test_null_series_and_partitions(spark, series):
    some, given = series
    named = given.withColumn("s", F.when(F.col("s") != "ar", F.col("s")))
    alone = named.where("s IS NULL")
    a = arma.search_forecast(alone, "s", "m", "t", "v", 2).collect()
    b = arma.search_forecast(given.where("s = 'ar'").repartition(11), "s", "m", "t", "v", 2).collect()
    assert [r.forecast for r in a] == pytest.approx([r.forecast for r in b]) and len(a) == 2

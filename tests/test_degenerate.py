"""Wide tables, gaps, constant columns, perfect and empty fits, many models at once."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casewise.operators import aggregate as agg
from casewise.operators import evaluate, linear, logistic
from casewise.operators import series as ts
from casewise.operators.cross import pair_matrix, pair_statistics


def gaps(rows, columns, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(loc=1e5, size=(rows, columns)) @ np.diag(rng.uniform(0.1, 50, columns))
    x[:, 1] += 0.7 * x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2], x[:, 3] = 7.25, np.nan
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(columns)])


@pytest.mark.parametrize("rows,columns,parts", [(300, 12, 1), (300, 12, 7), (400, 500, 4)])
def test_pair_matrix_with_gaps(spark, rows, columns, parts):
    """Equal to a library's pairwise correlation, also for 500 columns; a constant column has none, nor has an empty one."""
    local = gaps(rows, columns)
    given = spark.createDataFrame(local.astype(object).where(local.notna(), None), ", ".join(f"{c} double" for c in local)).repartition(parts)
    got = pair_matrix(given, list(local)).toPandas().pivot(index="var1", columns="var2", values="value").loc[list(local), list(local)]
    want = local.corr()
    want.loc["c2"] = want.loc[:, "c2"] = np.nan
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-7, equal_nan=True)


def test_pair_matrix_cases(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, float("nan"), 5.0, None), (3.0, 1.0, 5.0, 4.0), (None, 8.0, 5.0, None), (9.0, float("inf"), 5.0, None)]
    given = spark.createDataFrame(rows, "a double, b double, c double, d double")
    value = {(r.var1, r.var2): r.value for r in pair_matrix(given, ["a", "b", "c", "d"], "cov").collect()}
    assert len(value) == 16 and value["a", "b"] == pytest.approx(-1.0) and value["b", "a"] == value["a", "b"]
    assert value["c", "c"] == 0 and value["a", "c"] == 0 and value["d", "d"] is None and value["a", "d"] is None
    strict = {(r.var1, r.var2): r.value for r in pair_matrix(given, ["a", "b", "c"], "cov", "propagate").collect()}
    assert strict["c", "c"] == 0 and strict["a", "c"] is None and strict["b", "b"] is None
    n = {(r.i, r.j): (r.rows, r.n) for r in pair_statistics(given, ["a", "b"]).collect()}
    assert n == {(0, 0): (5, 4), (0, 1): (5, 2), (1, 1): (5, 3)}
    assert all(r.value is None for r in pair_matrix(given.limit(0), ["a", "b"]).collect())


def test_correlation_of_constants(spark):
    given = spark.createDataFrame([(1.0, 4.0, None), (2.0, 4.0, 3.0), (4.0, 4.0, None)], "a double, b double, c double")
    one = given.agg(agg.correlation("a", "b").alias("ab"), agg.correlation("a", "a").alias("aa"), agg.correlation("a", "c").alias("ac")).first()
    assert one.ab is None and one.ac is None and one.aa == pytest.approx(1)
    assert evaluate.holdout_r2(given, "a", "b").first().r2 is None and evaluate.holdout_r2(given.limit(0), "a", "b").first().r2 is None


def test_many_categories_are_spread(spark):
    rows = spark.range(300).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"), F.col("id").cast("double").alias("v"))
    out = agg.category_ratio(rows, "c", F.sum("v"))
    got = {(r.category, r.other): r.ratio for r in out.collect()}
    assert len(got) == 300 * 299 and got["c6", "c3"] == 2 and got["c3", "c0"] is None
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_series_without_a_month(spark):
    day = datetime.date
    rows = [("a", day(2020, 1, 1), 1.0), ("a", None, 9.0), ("a", day(2020, 3, 1), 3.0), ("b", None, 5.0), ("b", None, None)]
    given = spark.createDataFrame(rows, "s string, m date, v double")
    assert [(r.s, r.t, r.v) for r in ts.regular_series(given, "s", "m", "v").orderBy("t").collect()] == [("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 3.0)]
    assert {tuple(r) for r in ts.undated_rows(given, "s", "m").collect()} == {("a", 1), ("b", 2)}


def table(spark, rows, names="y x z"):
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names.split()))


def test_perfect_fit(spark):
    m = linear.moments(table(spark, [(3.0 + 2 * i, float(i), float(i * i)) for i in range(9)]), ["y", "x", "z"])
    fit = linear.fit_ols(m, "y", ["x"])
    assert fit.rss == 0 and fit.aic == -math.inf and fit.r2 == 1 and fit.estimate == pytest.approx([3, 2])
    rows = linear.ols_table(spark, fit).collect()
    assert [r.std_error for r in rows] == [0, 0] and all(r.p_value == 0 for r in rows)
    assert [s[1:3] for s in linear.stepwise_aic(m, "y", ["x", "z"])][0] == ("start", None)
    assert linear.backward_eliminate(m, "y", ["x", "z"], max_vif=1e9) is not None


def test_few_rows(spark):
    """Two rows determine two terms and no error; the third predictor has no estimate."""
    m = linear.moments(table(spark, [(1.0, 1.0, 5.0), (2.0, 3.0, 1.0)]), ["y", "x", "z"])
    rows = {r.term: r for r in linear.ols_table(spark, linear.fit_ols(m, "y", ["x", "z"])).collect()}
    assert rows["x"].estimate == pytest.approx(0.5) and rows["x"].std_error is None and rows["x"].p_value is None and rows["z"].estimate is None
    one = linear.moments(table(spark, [(4.0, 1.0, 5.0)]), ["y", "x", "z"])
    assert [r.estimate for r in linear.ols_table(spark, linear.fit_ols(one, "y", ["x"])).collect()] == [4.0, None]
    assert linear.stepwise_aic(one, "y", ["x", "z"])[0][:3] == (0, "start", None) and linear.backward_eliminate(one, "y", ["x", "z"]) == []


def test_no_rows_and_constant_response(spark):
    none = linear.moments(table(spark, []), ["y", "x", "z"])
    assert linear.ols_table(spark, linear.fit_ols(none, "y", ["x"])).count() == 0
    assert linear.stepwise_aic(none, "y", ["x", "z"]) == [] and linear.backward_eliminate(none, "y", ["x", "z"]) == []
    flat = linear.moments(table(spark, [(5.0, float(i), float(i % 2)) for i in range(6)]), ["y", "x", "z"])
    rows = linear.ols_table(spark, linear.fit_ols(flat, "y", ["x"])).collect()
    assert [r.estimate for r in rows] == [5.0, 0.0] and rows[0].r2 is None


@pytest.fixture(scope="module")
def outcomes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6)) * [1, 20, 0.1, 3, 1, 1] + [0, 500, 0, -2, 0, 0]
    x[:, 5] = x[:, 0] + 0.3 * x[:, 5]
    eta = 0.8 * x[:, 0] - 0.05 * (x[:, 1] - 500) + 4 * x[:, 2] - 1
    y = (rng.random(3000) < 1 / (1 + np.exp(-eta))).astype(float)
    local = pd.DataFrame(np.column_stack([y, x]), columns=["y", *"abcdef"])
    return spark.createDataFrame(local).repartition(5).cache()


def test_many_models_equal_single_fits(outcomes):
    models = [list("abcdef"), ["a"], ["b", "c"], ["f", "a"], []]
    for got, terms in zip(logistic.fit_many(outcomes, "y", models), models):
        if not terms:
            p = outcomes.agg(F.avg("y")).first()[0]
            assert got.estimate == pytest.approx([math.log(p / (1 - p))], abs=1e-8)
            continue
        want = logistic.fit_logistic(outcomes, "y", terms, tol=1e-12)
        for a, b in ((got.estimate, want.estimate), (got.std_error, want.std_error), (got.p_value, want.p_value), ([got.aic], [want.aic])):
            assert a == pytest.approx(b, rel=1e-6, abs=1e-6)
        assert got.vif == pytest.approx(logistic.logistic_vif(outcomes, want), rel=1e-5)


def test_a_step_costs_the_passes_of_one_fit(outcomes, monkeypatch):
    passes, sums = [], logistic._newton_sums
    monkeypatch.setattr(logistic, "_newton_sums", lambda data, models: passes.append(len(models)) or sums(data, models))
    (fit,) = logistic.fit_many(outcomes, "y", [list("abcdef")])
    alone = len(passes)
    passes.clear()
    trail = logistic.stepwise_aic_logistic(outcomes, "y", list("abcdef"))
    assert trail[0][3] == pytest.approx(fit.aic) and {t for _, action, t, _ in trail if action == "drop"} <= set("def")
    assert len(passes) <= (alone + 2) * (len(trail) + 1) and max(passes) >= 6
    kept = set("abcdef") - {t for _, t, *_ in logistic.backward_eliminate_logistic(outcomes, "y", list("abcdef"))}
    assert {"b", "c"} <= kept


def test_separable_and_empty_outcomes(spark):
    rows = table(spark, [(float(i > 4), float(i), 1.0) for i in range(10)])
    (fit,) = logistic.fit_many(rows, "y", [["x"]])
    assert fit.aic == pytest.approx(4, abs=1e-3) and np.isfinite(fit.estimate).all()
    assert logistic.stepwise_aic_logistic(rows.limit(0), "y", ["x"]) == []
    assert [s[1] for s in logistic.stepwise_aic_logistic(rows, "y", ["z"])] == ["start"]  # a constant predictor is aliased

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.functions.significance import t_two_sided, z_two_sided
from casewise.operators import evaluate as ev
from casewise.operators import linear, logistic, reduce
from casewise.plans import load


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(float(v) if v is not None else None for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def test_tail_probabilities():
    # Well-known quantiles.
    assert abs(t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(t_two_sided(12.7062, 1) - 0.05) < 1e-6
    assert abs(t_two_sided(1.959964, 1e7) - 0.05) < 1e-6
    assert abs(z_two_sided(1.959964) - 0.05) < 1e-6


def data(spark, n=400):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = 2 + 3 * a - b + rng.normal(size=n) * 0.5
    return frame(spark, a=a, b=b, c=c, d=a + b, y=y), np.column_stack([np.ones(n), a, b]), y


def test_ols_equals_least_squares(spark):
    df, x, y = data(spark)
    fit = linear.fit_ols(linear.moments(df, ["a", "b", "y"]), "y", ["a", "b"])
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    assert np.allclose(fit.estimate, beta) and abs(fit.rss - rss[0]) < 1e-8
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(y) - 3))
    assert np.allclose(fit.std_error, errors)
    assert fit.p_values()[1] < 1e-10 and 0.9 < fit.adj_r2 < fit.r2 < 1


def test_wide_moments_equal_aggregates(spark, monkeypatch):
    df, _, _ = data(spark)
    names = ["a", "b", "c", "y"]
    direct = linear.moments(df, names)
    monkeypatch.setattr(linear, "AGGREGATE_LIMIT", 1)
    wide = linear.moments(df.repartition(5), names)
    assert direct.n == wide.n and np.allclose(direct.cross, wide.cross) and np.allclose(direct.mean, wide.mean)


def test_rows_with_nulls_are_left_out(spark):
    df = frame(spark, a=[1, 2, None, 4], y=[2, 4, 6, 8])
    m = linear.moments(df, ["a", "y"])
    assert m.n == 3 and abs(linear.fit_ols(m, "y", ["a"]).estimate[1] - 2) < 1e-12


def test_alias_vif_and_selection(spark):
    df, _, _ = data(spark)
    m = linear.moments(df, ["a", "b", "c", "d", "y"])
    assert linear.aliased(m, ["a", "b", "c", "d"]) == ["d"]
    factors = linear.vif(m, ["a", "b", "c"])
    assert all(1 <= v < 1.2 for v in factors.values())
    kept = {"a", "b", "c"}
    for _, action, term, _ in linear.stepwise_aic(m, "y", ["a", "b", "c", "d"])[1:]:
        kept = kept - {term} if action == "drop" else kept | {term}
    assert {"a", "b"} <= kept
    assert [r[1] for r in linear.backward_eliminate(m, "y", ["a", "b", "c", "d"])] in ([], ["c"])


def test_stepwise_ends_where_no_single_move_helps(spark):
    df, _, _ = data(spark, 120)
    names = ["a", "b", "c"]
    m = linear.moments(df, [*names, "y"])
    trail = linear.stepwise_aic(m, "y", names)
    kept = set(names)
    for _, action, term, _ in trail[1:]:
        kept ^= {term}
    final = trail[-1][3]
    for term in names:
        other = [n for n in names if n in kept ^ {term}]
        assert linear.fit_ols(m, "y", other).aic >= final - 1e-9


def logit_data(spark, n=1500):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.5 + 1.2 * a)))).astype(float)
    return frame(spark, a=a, b=b, c=a + 0.1 * rng.normal(size=n), d=a - b, y=y), a, b, y


def test_logistic_equals_newton(spark):
    df, a, b, y = logit_data(spark)
    fit = logistic.fit_logistic(df, "y", ["a", "b"])
    x, beta = np.column_stack([np.ones(len(y)), a, b]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, x.T @ (y - p))
    assert np.allclose(fit.estimate, beta, atol=1e-6)
    assert np.allclose(fit.std_error, np.sqrt(np.diag(np.linalg.inv(info))), atol=1e-5)
    assert abs(fit.aic - (-2 * np.sum(np.where(y == 1, np.log(p), np.log(1 - p))) + 6)) < 1e-5
    factors = logistic.logistic_vif(df, logistic.fit_logistic(df, "y", ["a", "b", "c"]))
    assert all(v >= 1 for v in factors.values()) and factors["a"] > 5


def test_logistic_selection(spark):
    df, *_ = logit_data(spark, 600)
    dropped = [r[1] for r in logistic.backward_eliminate_logistic(df, "y", ["a", "b", "c", "d"])]
    assert dropped and "d" not in dropped and not {"a", "c"} <= set(dropped)
    trail = logistic.stepwise_aic_logistic(df, "y", ["a", "b"])
    assert [t[3] for t in trail] == sorted((t[3] for t in trail), reverse=True)


def test_null_predictor_gives_null_score(spark):
    df = frame(spark, a=[1, None])
    scores = [r[0] for r in df.select(logistic.probability(["(Intercept)", "a"], [0.0, 1.0])).collect()]
    assert abs(scores[0] - 1 / (1 + math.exp(-1))) < 1e-12 and scores[1] is None


def scored(spark, n=500, ties=True, seed=2):
    rng = np.random.default_rng(seed)
    s = rng.uniform(size=n)
    s = np.round(s, 1) if ties else s
    y = (rng.uniform(size=n) < s).astype(int)
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "key int, label int, score double"), y, s


@pytest.mark.parametrize("ties", [True, False])
def test_auc_and_ks_by_brute_force(spark, ties):
    df, y, s = scored(spark, ties=ties)
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(ev.roc_auc(df, "label", "score").first()["auc"] - auc) < 1e-12
    flipped = ev.roc_auc(df.withColumn("score", -F.col("score")), "label", "score").first()["auc"]
    assert abs(auc + flipped - 1) < 1e-12
    ks = max((pos >= c).mean() - (neg >= c).mean() for c in np.unique(s))
    assert abs(ev.ks_statistic(df, "label", "score").first()["ks"] - ks) < 1e-12
    points = ev.roc_points(df, "label", "score").orderBy(F.col("score").desc()).collect()
    assert all(a["tpr"] <= b["tpr"] and a["fpr"] <= b["fpr"] for a, b in zip(points, points[1:]))


def test_cutoff_sweep_equals_single_cutoffs(spark):
    df, y, s = scored(spark)
    for r in ev.cutoff_sweep(df, "label", "score").collect():
        assert abs(r["sensitivity"] - (s[y == 1] >= r["cutoff"]).mean()) < 1e-12
        assert abs(r["specificity"] - (s[y == 0] < r["cutoff"]).mean()) < 1e-12
    one = ev.binary_metrics(df, "label", "score", 0.5).first()
    assert one["tp"] + one["fp"] + one["fn"] + one["tn"] == 500


def test_no_positive_rows(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.9)], "key int, label int, score double")
    assert ev.roc_auc(df, "label", "score").first()["auc"] is None
    assert ev.binary_metrics(df, "label", "score", 0.5).first()["sensitivity"] is None


def test_gain_lift_totals(spark):
    df, y, _ = scored(spark)
    table = ev.gain_lift(df, "key", "label", "score").orderBy("bucket").collect()
    assert [r["total"] for r in table] == [50] * 10
    assert table[-1]["cum_responders"] == y.sum() and abs(table[-1]["gain"] - 100) < 1e-9 and abs(table[-1]["lift"] - 1) < 1e-9


def test_class_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)], "a int, p int")
    got = {r["class"]: r for r in ev.class_accuracy(df, "a", "p").collect()}
    assert (got[0]["sensitivity"], got[1]["sensitivity"], got[2]["sensitivity"]) == (0.5, 1.0, 0.5)
    assert (got[0]["specificity"], got[1]["specificity"]) == (1.0, 0.5)


def test_splits_do_not_depend_on_partitions(spark):
    base = spark.range(2000).select("id", (F.col("id") % 4 == 0).cast("int").alias("c"))
    runs = []
    for parts in (1, 64):
        df = base.repartition(parts)
        plain = {r["id"] for r in ev.split_random(df, "id", 0.7).where("is_train").collect()}
        strat = {r["id"] for r in ev.split_stratified(df, "id", "c", 0.2).where("is_train").collect()}
        runs.append((plain, strat))
    assert runs[0] == runs[1]
    assert abs(len(runs[0][0]) / 2000 - 0.7) < 0.05
    assert sum(i % 4 == 0 for i in runs[0][1]) == 100 and len(runs[0][1]) == 400


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = reduce.pca_variance(df, "v", 5).orderBy("component").collect()
    assert np.allclose([r["share"] for r in got], values / values.sum()) and abs(got[-1]["cumulative"] - 1) < 1e-9
    projected = reduce.pca_project(reduce.fit_pca(df, "v", 2), df, "v")
    assert abs(projected.select(F.var_samp(F.get("projected", 0))).first()[0] - values[0]) < 1e-6 * values[0]


def test_kernel_features_separate_a_ring(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    rows = [(i, v.tolist(), int(v @ v > 1.4)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, v array<double>, y int")
    mapped = reduce.fourier_features(df, "v", 2, 100, 0.5)
    near = mapped.collect()
    kernel = np.array([r["_features"].toArray() for r in near[:40]])
    exact = np.exp(-0.5 * ((x[:40, None] - x[None, :40]) ** 2).sum(-1))
    assert np.abs(kernel @ kernel.T - exact).max() < 0.5
    for head in ("logistic", "svc"):
        model = reduce.kernel_classifier(mapped, "y", 400, cost=2.0, head=head)
        called = model.transform(mapped).withColumn("p", F.col("prediction").cast("int"))
        assert ev.overall_accuracy(called, "y", "p").first()["accuracy"] > 0.9
    table = reduce.cross_validate_grid(mapped, "k", "y", [0.1, 2.0], folds=3).collect()
    assert len(table) == 2 and sum(r["is_best"] for r in table) == 1 and all(r["accuracy"] > 0.6 for r in table)


def test_cross_validation_passes_have_a_task_for_each_core(spark, monkeypatch):
    """What a pass sends to the driver doesn't grow with the partitions of the table."""
    tasks = []

    class Fitted:
        avgMetrics = [0.5, 0.6]

    class Spy:
        def __init__(self, **_):
            pass

        def fit(self, rows):
            tasks.append((rows.rdd.getNumPartitions(), rows.count()))
            return Fitted

    monkeypatch.setattr(reduce, "CrossValidator", Spy)
    df = spark.range(0, 500, 1, 100).selectExpr("id AS k", "id % 2 AS y")
    table = reduce.cross_validate_grid(df, "k", "y", [0.1, 2.0]).collect()
    assert tasks[0][0] <= spark.sparkContext.defaultParallelism and tasks[0][1] == 500
    assert [r["is_best"] for r in table] == [False, True]


def test_the_grid_is_fitted_on_all_vectors(spark, tmp_path, monkeypatch):
    """No sample of the vectors: every row reaches the folds."""
    seen = []

    def spy(rows, key, *_):
        seen.extend(r[0] for r in rows.select(key).collect())
        return spark.createDataFrame([(1.0, 0.5, True)], "cost double, accuracy double, is_best boolean")

    monkeypatch.setattr(reduce, "cross_validate_grid", spy)
    rows = [(i, [float(i % 7), float(i % 3)], i % 4) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    load().QUERIES["cross_validate_grid"](spark, str(tmp_path)).collect()
    assert sorted(seen) == list(range(200))

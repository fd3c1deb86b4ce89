"""Registered queries: splits, regression, selection, evaluation and dimension reduction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from casewise.operators import evaluate as ev
from casewise.operators import landmarks, linear, logistic, reduce, subspace
from casewise.plans import lenses as lens
from casewise.plans.registry import query
from casewise.plans.shape import tidy
from casewise.session import stage

SEED = 100
HASH_SQL = "('0x' || substr(md5('100:' || {key}), 1, {digits}))::UBIGINT"
CAR_PREDICTORS = ["size", "wheel", "width", "power", "span"]
RISK_PREDICTORS = ["price", "income", "tenure", "priority", "span"]


def _width(spark, folder) -> int:
    """Values in a vector; all vectors have the same."""
    first = lens.vec(spark, folder).where(F.col("pixels").isNotNull()).select(F.size("pixels")).first()
    return first[0] if first else 0


# ---------------------------------------------------------------- splits


@query("split_random", "loan", f"""
    SELECT loan_id, {HASH_SQL.format(key='loan_id', digits=8)} < {int(0.7 * 2**32)} AS is_train FROM loan""")
def _(spark, folder):
    return ev.split_random(lens.loan(spark, folder).select("loan_id"), "loan_id", 0.7, SEED)


def _stratified_sql(share):
    return f"""SELECT vec_id, digit, row_number() OVER (PARTITION BY digit ORDER BY {HASH_SQL.format(key='vec_id', digits=13)})
        <= floor(count(*) OVER (PARTITION BY digit) * {share}::DOUBLE + 0.5) AS is_train FROM vec"""


@query("split_stratified", "vec", _stratified_sql(0.7))
def _(spark, folder):
    return ev.split_stratified(lens.vec(spark, folder).select("vec_id", "digit"), "vec_id", "digit", 0.7, SEED)


@query("sample_stratified", "vec", f"SELECT vec_id, digit FROM ({_stratified_sql(0.2)}) WHERE is_train")
def _(spark, folder):
    marked = ev.split_stratified(lens.vec(spark, folder).select("vec_id", "digit"), "vec_id", "digit", 0.2, SEED)
    return marked.where("is_train").drop("is_train")


# ---------------------------------------------------------------- linear models


@query("ols_fit", "car", """
    WITH m AS (SELECT count(*) AS n, avg(size) AS a, avg(width) AS b, avg(price) AS c,
                      var_pop(size) * count(*) AS s11, var_pop(width) * count(*) AS s22, covar_pop(size, width) * count(*) AS s12,
                      covar_pop(size, price) * count(*) AS s1y, covar_pop(width, price) * count(*) AS s2y, var_pop(price) * count(*) AS syy FROM car),
    inv AS (SELECT *, s22 / (s11 * s22 - s12 * s12) AS i11, s11 / (s11 * s22 - s12 * s12) AS i22, -s12 / (s11 * s22 - s12 * s12) AS i12 FROM m),
    b AS (SELECT *, i11 * s1y + i12 * s2y AS b1, i12 * s1y + i22 * s2y AS b2 FROM inv),
    r AS (SELECT *, c - b1 * a - b2 * b AS b0, syy - b1 * s1y - b2 * s2y AS rss FROM b),
    v AS (SELECT *, rss / (n - 3) AS v, 1 - rss / syy AS r2 FROM r),
    t AS (SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(v * (1 / n + a * a * i11 + 2 * a * b * i12 + b * b * i22)) AS se, r2, n FROM v
          UNION ALL SELECT 'size', b1, sqrt(v * i11), r2, n FROM v UNION ALL SELECT 'width', b2, sqrt(v * i22), r2, n FROM v)
    SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate / se, 6) AS t_value,
           round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r2 FROM t""")
def _(spark, folder):
    m = linear.moments(lens.car(spark, folder), ["size", "width", "price"])
    return tidy(linear.ols_table(spark, linear.fit_ols(m, "price", ["size", "width"])).drop("p_value"))


@query("ols_significance")
def _(spark, folder):
    m = linear.moments(lens.car(spark, folder), [*CAR_PREDICTORS, "price"])
    usable = [p for p in CAR_PREDICTORS if p not in linear.aliased(m, CAR_PREDICTORS)]
    return tidy(linear.ols_table(spark, linear.fit_ols(m, "price", usable)))


@query("alias_check", "car", """
    SELECT 'span' AS term FROM car HAVING abs(corr(span, size + wheel) - 1) < 1e-12""")
def _(spark, folder):
    m = linear.moments(lens.car(spark, folder), CAR_PREDICTORS)
    return spark.createDataFrame([(t,) for t in linear.aliased(m, CAR_PREDICTORS)], "term string")


@query("vif", "car", """
    SELECT unnest(['size', 'power']) AS term, round(1 / (1 - corr(size, power) ** 2), 4) AS vif FROM car""")
def _(spark, folder):
    m = linear.moments(lens.car(spark, folder), ["size", "power"])
    return tidy(linear.vif_table(spark, linear.vif(m, ["size", "power"])), 4)


@query("vif_many", "car", """
    WITH r AS (SELECT corr(size, power) AS sp, corr(size, wheel) AS sw, corr(power, wheel) AS pw FROM car),
    d AS (SELECT *, 1 + 2 * sp * sw * pw - sp * sp - sw * sw - pw * pw AS det FROM r)
    SELECT unnest(['size', 'power', 'wheel']) AS term, round(unnest([(1 - pw * pw) / det, (1 - sw * sw) / det, (1 - sp * sp) / det]), 4) AS vif FROM d""")
def _(spark, folder):
    names = ["size", "power", "wheel"]
    m = linear.moments(lens.car(spark, folder), names)
    return tidy(linear.vif_table(spark, linear.vif(m, names)), 4)


def _step_rows(spark, trail):
    return spark.createDataFrame(trail, "step int, action string, term string, aic double")


def _drop_rows(spark, trail):
    return spark.createDataFrame(trail, "step int, term string, reason string, vif double, p_value double")


# All subsets of three predictors a, b, c (bits 1, 2, 4) with their residual sum, AIC and determinants:
# R2 of a subset is one less the ratio of the correlation determinants with and without the response.
SUBSET_SQL = """
    bits AS (SELECT unnest([1, 2, 4]) AS bit, unnest(['size', 'width', 'power']) AS term),
    r AS (SELECT count(*) AS n, var_pop(price) * count(*) AS syy, corr(size, width) AS ab, corr(size, power) AS ac, corr(width, power) AS bc,
                 corr(size, price) AS ay, corr(width, price) AS yb, corr(power, price) AS cy FROM car),
    e AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS d3 FROM r),
    dets AS (SELECT n, syy, unnest([0, 1, 2, 4, 3, 5, 6, 7]) AS s,
        unnest([1, 1, 1, 1, 1 - ab * ab, 1 - ac * ac, 1 - bc * bc, d3]) AS d,
        unnest([1, 1 - ay * ay, 1 - yb * yb, 1 - cy * cy, 1 + 2 * ab * ay * yb - ab * ab - ay * ay - yb * yb,
                1 + 2 * ac * ay * cy - ac * ac - ay * ay - cy * cy, 1 + 2 * bc * yb * cy - bc * bc - yb * yb - cy * cy,
                d3 - ((1 - bc * bc) * ay * ay + (1 - ac * ac) * yb * yb + (1 - ab * ab) * cy * cy + 2 * (ac * bc - ab) * ay * yb
                      + 2 * (ab * bc - ac) * ay * cy + 2 * (ab * ac - bc) * yb * cy)]) AS dy FROM e),
    sub AS (SELECT s, n, d, bit_count(s) AS k, syy * dy / d AS rss, n * ln(syy * dy / d / n) + 2 * (bit_count(s) + 1) AS aic FROM dets)
"""
THREE = ["size", "width", "power"]


@query("stepwise_aic", "car", "WITH RECURSIVE " + SUBSET_SQL.rstrip() + """,
    walk AS (SELECT 0 AS step, 'start' AS action, NULL::VARCHAR AS term, s, aic FROM sub WHERE s = 7
             UNION ALL
             SELECT w.step + 1, CASE WHEN w.s & b.bit > 0 THEN 'drop' ELSE 'add' END, b.term, m.s, m.aic
             FROM walk w, bits b, sub m WHERE m.s = xor(w.s, b.bit) AND m.aic < w.aic - 1e-9
             QUALIFY row_number() OVER (ORDER BY m.aic) = 1)
    SELECT step::BIGINT AS step, action, term, round(aic, 4) AS aic FROM walk""")
def _(spark, folder):
    m = linear.moments(lens.car(spark, folder), [*THREE, "price"])
    return tidy(_step_rows(spark, linear.stepwise_aic(m, "price", THREE)), 4)


# 3.8461 is the square of the two-sided five-percent point of t at about 2,000 degrees of freedom.
@query("backward_eliminate", "car", "WITH RECURSIVE " + SUBSET_SQL.rstrip() + """,
    walk AS (SELECT 0 AS step, NULL::VARCHAR AS term, NULL::VARCHAR AS reason, NULL::DOUBLE AS vif, 7 AS s
             UNION ALL
             SELECT step + 1, term, CASE WHEN wide THEN 'vif' ELSE 'p' END, vif, s FROM (
                 SELECT step, term, vif, s, t2, vif > max(vif) OVER () * (1 - 1e-9) AND vif > 5 AND t2 < 3.8461 AS wide FROM (
                     SELECT w.step, b.term, less.s, less.d / whole.d AS vif, (less.rss - whole.rss) / (whole.rss / (whole.n - whole.k - 1)) AS t2
                     FROM walk w, bits b, sub whole, sub less
                     WHERE whole.s = w.s AND w.s & b.bit > 0 AND less.s = xor(w.s, b.bit)))
             WHERE t2 < 3.8461 QUALIFY row_number() OVER (ORDER BY wide DESC, t2) = 1)
    SELECT step::BIGINT AS step, term, reason, round(vif, 3) AS vif FROM walk WHERE step > 0""")
def _(spark, folder):
    m = linear.moments(lens.car(spark, folder), [*THREE, "price"])
    return tidy(_drop_rows(spark, linear.backward_eliminate(m, "price", THREE)).drop("p_value"), 3)


@query("stepwise_aic_aliased")
def _(spark, folder):
    m = linear.moments(lens.car(spark, folder), [*CAR_PREDICTORS, "price"])
    return tidy(_step_rows(spark, linear.stepwise_aic(m, "price", CAR_PREDICTORS)), 4)


@query("backward_eliminate_aliased")
def _(spark, folder):
    m = linear.moments(lens.car(spark, folder), [*CAR_PREDICTORS, "price"])
    return tidy(_drop_rows(spark, linear.backward_eliminate(m, "price", CAR_PREDICTORS)), 4)


@query("holdout_r2", "car", f"""
    WITH parted AS (SELECT size, price, {HASH_SQL.format(key='car_id', digits=8)} < {int(0.7 * 2**32)} AS is_train FROM car),
    fit AS (SELECT regr_slope(price, size) AS b, regr_intercept(price, size) AS a FROM parted WHERE is_train)
    SELECT round(corr(price, a + b * size) ** 2, 6) AS r2 FROM parted, fit WHERE NOT is_train""")
def _(spark, folder):
    cars = ev.split_random(lens.car(spark, folder), "car_id", 0.7, SEED)
    fit = linear.fit_ols(linear.moments(cars.where("is_train"), ["size", "price"]), "price", ["size"])
    held = cars.where("NOT is_train").withColumn("predicted", linear.linear_score(fit.terms, fit.estimate))
    return tidy(ev.holdout_r2(held, "price", "predicted"))


# ---------------------------------------------------------------- logistic models


# Newton's method for one predictor ``x`` and outcome ``label`` of a table ``rows``.
NEWTON_SQL = """
    it AS (
        SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS e0, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS ll
        UNION ALL
        SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01),
               sqrt(h11 / (h00 * h11 - h01 * h01)), sqrt(h00 / (h00 * h11 - h01 * h01)), l
        FROM (SELECT i, b0, b1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11,
                     sum(label - p) AS g0, sum((label - p) * x) AS g1, sum(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS l
              FROM (SELECT i, b0, b1, x, label, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it, rows WHERE i < 15) GROUP BY i, b0, b1))
"""


@query("logistic_fit", "risk", "WITH RECURSIVE rows AS (SELECT label, price AS x FROM risk), " + NEWTON_SQL + """
    SELECT unnest(['(Intercept)', 'price']) AS term, round(unnest([b0, b1]), 5) AS estimate, round(unnest([e0, e1]), 5) AS std_error,
           round(-2 * ll + 4, 3) AS aic FROM it WHERE i = 15""")
def _(spark, folder):
    fit = logistic.fit_logistic(lens.risk(spark, folder), "label", ["price"])
    table = logistic.logistic_table(spark, fit).drop("z_value", "p_value")
    return tidy(table.withColumn("aic", F.round("aic", 3)), 5)


@query("logistic_significance")
def _(spark, folder):
    fit = logistic.fit_logistic(lens.risk(spark, folder), "label", RISK_PREDICTORS)
    return tidy(logistic.logistic_table(spark, fit), 4)


@query("vif_logistic")
def _(spark, folder):
    rows = lens.risk(spark, folder)
    names = ["price", "income", "span"]
    fit = logistic.fit_logistic(rows, "label", names)
    return tidy(linear.vif_table(spark, logistic.logistic_vif(rows.dropna(subset=names), fit)), 4)


@query("stepwise_aic_logistic")
def _(spark, folder):
    trail = logistic.stepwise_aic_logistic(lens.risk(spark, folder), "label", ["price", "income", "tenure"])
    return tidy(_step_rows(spark, trail), 3)


@query("backward_eliminate_logistic")
def _(spark, folder):
    trail = logistic.backward_eliminate_logistic(lens.risk(spark, folder), "label", RISK_PREDICTORS)
    return tidy(_drop_rows(spark, trail), 4)


@query("score_probability", "risk", f"""
    WITH RECURSIVE parted AS (SELECT *, {HASH_SQL.format(key='key', digits=8)} < {int(0.7 * 2**32)} AS is_train FROM risk),
    rows AS (SELECT label, span AS x FROM parted WHERE is_train AND span IS NOT NULL), """ + NEWTON_SQL + """
    SELECT key, label::BIGINT AS label, round(1 / (1 + exp(-(b0 + b1 * span))), 5) AS probability FROM parted, it WHERE i = 15 AND NOT is_train""")
def _(spark, folder):
    rows = ev.split_random(lens.risk(spark, folder), "key", 0.7, SEED)
    fit = logistic.fit_logistic(rows.where("is_train"), "label", ["span"])
    held = rows.where("NOT is_train")
    return tidy(held.select("key", "label", logistic.probability(fit.terms, fit.estimate).alias("probability")), 5)


@query("score_given_coefficients", "risk", """
    SELECT key, round(1 / (1 + exp(-(-2.5::DOUBLE + 0.9::DOUBLE * price + 0.05::DOUBLE * span))), 6) AS probability FROM risk""")
def _(spark, folder):
    score = logistic.probability(["(Intercept)", "price", "span"], [-2.5, 0.9, 0.05])
    return tidy(lens.risk(spark, folder).select("key", score.alias("probability")))


# ---------------------------------------------------------------- evaluation

BINARY_SQL = """
    WITH c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.45) AS tp, count(*) FILTER (label = 0 AND score >= 0.45) AS fp,
                      count(*) FILTER (label = 1 AND score < 0.45) AS fn, count(*) FILTER (label = 0 AND score < 0.45) AS tn FROM score)
    SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity FROM c"""


@query("confusion_matrix", "score", """
    SELECT label::BIGINT AS label, CASE WHEN score >= 0.45 THEN 1 ELSE 0 END::BIGINT AS predicted, count(*) AS rows FROM score GROUP BY ALL""")
def _(spark, folder):
    called = lens.score(spark, folder).withColumn("predicted", (F.col("score") >= 0.45).cast("long"))
    return tidy(ev.confusion_matrix(called, "label", "predicted"))


@query("binary_metrics", "score", BINARY_SQL)
def _(spark, folder):
    return tidy(ev.binary_metrics(lens.score(spark, folder), "label", "score", 0.45))


@query("class_accuracy", "vec", """
    WITH p AS (SELECT digit, (vec_id * 7) % 10 AS called FROM vec),
    side AS (SELECT d AS class, count(*) FILTER (digit = d) AS rows, count(*) FILTER (called = d) AS called,
                    count(*) FILTER (digit = d AND called = d) AS hits, count(*) AS n FROM p, (SELECT unnest(range(10)) AS d) GROUP BY d)
    SELECT class, rows, hits, round(hits / rows, 6) AS sensitivity, round((n - rows - called + hits) / (n - rows), 6) AS specificity,
           round((hits / rows + (n - rows - called + hits) / (n - rows)) / 2, 6) AS balanced_accuracy FROM side""")
def _(spark, folder):
    called = lens.vec(spark, folder).select("digit", (F.col("vec_id") * 7 % 10).alias("called"))
    return tidy(ev.class_accuracy(called, "digit", "called"))


def _sweep_sql(where=""):
    return f"""
    WITH cut AS (SELECT 0.01::DOUBLE + i * ((0.8::DOUBLE - 0.01::DOUBLE) / 99) AS cutoff FROM (SELECT unnest(range(100)) AS i)),
    c AS (SELECT cutoff, count(*) FILTER (label = 1 AND score >= cutoff) AS tp, count(*) FILTER (label = 0 AND score < cutoff) AS tn,
                 count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM cut, score GROUP BY cutoff)
    SELECT round(cutoff, 6) AS cutoff, round(tp / p, 6) AS sensitivity, round(tn / n, 6) AS specificity, round((tp + tn) / (p + n), 6) AS accuracy
    FROM c {where}"""


@query("cutoff_sweep", "score", _sweep_sql())
def _(spark, folder):
    return tidy(ev.cutoff_sweep(lens.score(spark, folder), "label", "score"))


@query("balanced_cutoff", "score", _sweep_sql("WHERE abs(tp / p - tn / n) < 0.01"))
def _(spark, folder):
    return tidy(ev.balanced_cutoff(ev.cutoff_sweep(lens.score(spark, folder), "label", "score")))


CURVE_SQL = """
    WITH one AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {view} GROUP BY score),
    curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM one
              WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""
ROC = "SELECT round(score, 6) AS score, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM curve"
AUC = "SELECT max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, round(sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)), 6) AS auc FROM curve"


@query("ks_statistic", "score", CURVE_SQL.format(view="score") + "SELECT round(max(tp / p - fp / n), 6) AS ks FROM curve")
def _(spark, folder):
    return tidy(ev.ks_statistic(lens.score(spark, folder), "label", "score"))


@query("ks_statistic_ties", "coarse", CURVE_SQL.format(view="coarse") + "SELECT round(max(tp / p - fp / n), 6) AS ks FROM curve")
def _(spark, folder):
    return tidy(ev.ks_statistic(lens.coarse(spark, folder), "label", "score"))


@query("gain_lift", "score", """
    WITH b AS (SELECT label, ntile(10) OVER (ORDER BY score DESC, key) AS bucket FROM score),
    g AS (SELECT bucket, count(*) AS total, sum(label)::BIGINT AS responders FROM b GROUP BY bucket),
    c AS (SELECT *, sum(responders) OVER (ORDER BY bucket)::BIGINT AS cum_responders, sum(responders) OVER () AS every FROM g)
    SELECT bucket, total, responders, cum_responders, round(cum_responders * 100 / every, 6) AS gain,
           round(cum_responders * 100 / every / (bucket * 10), 6) AS lift FROM c""")
def _(spark, folder):
    return tidy(ev.gain_lift(lens.score(spark, folder), "key", "label", "score"))


@query("roc_points", "coarse", CURVE_SQL.format(view="coarse") + ROC)
def _(spark, folder):
    return tidy(ev.roc_points(lens.coarse(spark, folder), "label", "score"))


@query("roc_auc", "score", CURVE_SQL.format(view="score") + AUC)
def _(spark, folder):
    return tidy(ev.roc_auc(lens.score(spark, folder), "label", "score"))


@query("roc_auc_ties", "coarse", CURVE_SQL.format(view="coarse") + AUC)
def _(spark, folder):
    return tidy(ev.roc_auc(lens.coarse(spark, folder), "label", "score"))


# ---------------------------------------------------------------- vectors


@query("pca_variance")
def _(spark, folder):
    return tidy(reduce.pca_variance(lens.vec(spark, folder), "pixels", _width(spark, folder)))


def _split_vectors(spark, folder):
    return ev.split_stratified(lens.vec(spark, folder), "vec_id", "digit", 0.7, SEED)


@query("pca_project")
def _(spark, folder):
    marked = _split_vectors(spark, folder)
    model = reduce.fit_pca(marked.where("is_train"), "pixels", 45)
    out = reduce.pca_project(model, marked, "pixels")
    # The sign of a component is arbitrary.
    components = F.transform("projected", lambda x: F.round(F.abs(x), 4) + 0.0)
    return out.select("vec_id", "is_train", components.alias("components"))


@query("pca_leading")
def _(spark, folder):
    """Shares of the leading components, found without the covariance of all dimensions."""
    found = subspace.leading_components(lens.vec(spark, folder), "pixels", 5)
    rows = [(i, float(v), float(c)) for i, (v, c) in enumerate(zip(found.share, np.cumsum(found.share)), 1)] if found else []
    return tidy(spark.createDataFrame(rows, "component long, share double, cumulative double"))


@query("kernel_classifier")
def _(spark, folder):
    # Split and features are used by every round, iteration and by the scoring; they are worked out once.
    vectors = stage(_split_vectors(spark, folder).select("vec_id", "digit", "is_train", "pixels"), "vectors")
    found = landmarks.choose(vectors.where("is_train"), "vec_id", "pixels", 96, 1.0 / _width(spark, folder), seed=SEED)
    rows = stage(landmarks.features(vectors, "pixels", found).select("digit", "is_train", "_features"), "features")
    train = rows.where("is_train")
    model = reduce.kernel_classifier(train, "digit", train.count(), cost=2.0)
    called = model.transform(rows.where("NOT is_train")).select("digit", F.col("prediction").cast("long").alias("predicted"))
    return tidy(ev.class_accuracy(called, "digit", "predicted"))


@query("cross_validate_grid")
def _(spark, folder):
    width = _width(spark, folder)
    rows = reduce.fourier_features(lens.vec(spark, folder), "pixels", width, 96, 1.0 / width, SEED).drop("pixels")
    return tidy(reduce.cross_validate_grid(rows, "vec_id", "digit", [0.1, 0.5, 1.0, 2.0]))

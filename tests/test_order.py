import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.operators import clean, order, rank
from casewise.operators import aggregate as agg


def skewed(spark):
    """One group holds most rows, most of them equal; one far outlier; one all-NULL and one one-row group."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.lognormal(3, 1, 4000)] + [("hot", 7.5)] * 2000 + [("hot", 1e12)]
    rows += [("cold", float(v)) for v in range(7)] + [("one", 4.25)] + [("none", None)] * 3 + [(None, 1.0), (None, 3.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(13)


def test_quantiles_equal_numpy(spark):
    rows, df = skewed(spark)
    got = {r["g"]: r for r in order.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.9}, ["g"]).collect()}
    assert set(got) == {"hot", "cold", "one", None}
    for g, r in got.items():
        values = [v for k, v in rows if k == g]
        assert r["n"] == len(values)
        assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(values, [0.25, 0.5, 0.9]), rtol=1e-12)


def test_global_quantile(spark):
    rows, df = skewed(spark)
    r = order.quantiles(df, "v", {"m": 0.5}, []).first()
    assert r["m"] == np.median([v for _, v in rows if v is not None])


@pytest.mark.parametrize("values, lower, median, upper", [
    ([1, 2, 3, 4], 1.5, 2.5, 3.5), ([1, 2, 3, 4, 5], 2, 3, 4), ([5], 5, 5, 5), ([1, 9], 1, 5, 9),
])
def test_hinges(spark, values, lower, median, upper):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    r = order.hinges(df, "v").first()
    assert (r["lower"], r["median"], r["upper"]) == (lower, median, upper)


def test_box_stats_flags_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    r = agg.box_stats(df, "v").first()
    assert (r["low_whisker"], r["high_whisker"], r["outliers"]) == (1.0, 5.0, 1)
    assert clean.outlier_to_null(df, "v").where("v IS NULL").count() == 1


def test_rank_and_running_totals_do_not_depend_on_partitions(spark):
    base = spark.range(5000).select("id", (F.col("id") % 3).alias("s"))
    for parts in (1, 64):
        df = base.repartition(parts)
        ranked = {r["id"]: r["rank"] for r in order.rank_rows(df, [F.col("s").desc(), F.col("id")]).collect()}
        expected = sorted(range(5000), key=lambda i: (-(i % 3), i))
        assert [ranked[i] for i in expected] == list(range(1, 5001))
        total = order.running_totals(df, [F.col("s").desc(), F.col("id")], {"run": "s"}).agg(F.max("run")).first()[0]
        assert total == sum(i % 3 for i in range(5000))


@pytest.mark.parametrize("n, groups", [(10, 3), (7, 10), (100, 10), (1, 4)])
def test_ntile_equals_sql(spark, n, groups):
    df = spark.range(n).select(F.col("id").alias("key"))
    got = {r["key"]: r["bucket"] for r in rank.bucket_ntile(df, [F.col("key")], groups).collect()}
    want = spark.sql(f"SELECT id, ntile({groups}) OVER (ORDER BY id) AS b FROM range({n})").collect()
    assert got == {r["id"]: r["b"] for r in want}


def test_row_slice(spark):
    got = [r["id"] for r in clean.row_slice(spark.range(23), [F.col("id")], skip=10, every=5).orderBy("id").collect()]
    assert got == [10, 15, 20]


def test_rank_helpers_on_ties(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 3.0), ("d", None)], "k string, m double")
    assert [r["k"] for r in rank.top_n_with_ties(df, "m").orderBy("k").collect()] == ["a", "b"]
    assert [r["k"] for r in rank.nth_ranked(df, "m", 2).collect()] == ["c"]
    assert rank.nth_ranked(df, "m", 3).count() == 0
    assert rank.arg_extreme(df, "k", "m").first()["k"] == "a"
    assert rank.arg_extreme(df, "k", "m", largest=False).first()["k"] == "c"


def test_order_values_keep_their_type_and_take_nan(spark):
    """Whole numbers beyond 2^53 stay exact; NaN is the largest value; a long tail doesn't gather in one cell."""
    big = [2**60 + i * 3 for i in range(999)]
    df = spark.createDataFrame([(v,) for v in big], "v long").repartition(5)
    assert order.order_values(df, "v", lambda n: {"m": F.floor((n + 1) / 2)}).first()["m"] == big[499]
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (2.0,), (float("-inf"),)], "v double")
    r = order.order_values(odd, "v", lambda n: {"a": F.lit(1), "b": F.lit(4), "c": F.lit(5)}).first()
    assert r["a"] == float("-inf") and r["b"] == float("inf") and r["c"] != r["c"]


def test_final_windows_are_small_on_long_tails(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.lognormal(3, 4, 20000)] + [1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cuts = df.select("v").distinct().agg(F.percentile_approx("v", [i / order.CELLS for i in range(1, order.CELLS)], 10 * order.CELLS).alias("c"))
    cells = df.select("v").distinct().join(cuts).groupBy(F.size(F.filter("c", lambda c: c < F.col("v")))).count()
    assert cells.agg(F.max("count")).first()[0] < 3 * len(values) / order.CELLS
    assert order.quantiles(df, "v", {"m": 0.5}).first()["m"] == pytest.approx(float(np.median(values)))


def test_order_values_of_many_shapes(spark):
    """Every rank that is asked, for groups of one row to thousands, all ties, long tails and whole numbers beyond doubles."""
    rng = np.random.default_rng(8)
    shapes = {"ties": [5] * 3000, "two": [1, 2] * 700, "big": [2**61 + i for i in range(2500)], "tail": [int(v) for v in np.exp(rng.uniform(0, 40, 6000))], "one": [7], "few": [3, 1, 2]}
    rows = [(g, int(v)) for g, values in shapes.items() for v in values] + [(None, 4), ("ties", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(9)
    shares = {"first": 0.0, "a": 0.013, "b": 0.25, "c": 0.2504, "d": 0.77, "last": 1.0}
    got = order.order_values(df, "v", lambda n: {k: F.greatest(F.ceil(n * F.lit(p)), F.lit(1)) for k, p in shares.items()}, ["g"]).collect()
    assert {r["g"] for r in got} == {*shapes, None}
    for r in got:
        values = sorted(v for g, v in rows if g == r["g"] and v is not None)
        assert r["n"] == len(values)
        for k, p in shares.items():
            assert r[k] == values[max(int(np.ceil(len(values) * p)), 1) - 1], (r["g"], k)
    assert order.order_values(df.limit(0), "v", lambda n: {"m": n}, ["g"]).count() == 0
    assert order.order_values(df.limit(0), "v", lambda n: {"m": n}).first()["m"] is None


def test_only_values_in_between_move(spark, tmp_path):
    """Of 200,000 different values under one percent are kept for three ranks, and dates and decimals work too."""
    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_003).cast("double").alias("v"))
    seen, stage = [], order.stage
    try:
        order.stage = lambda d, label: seen.append((label, stage(d, label))) or seen[-1][1]
        assert order.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()["b"] == pytest.approx(df.toPandas().v.median())
    finally:
        order.stage = stage
    assert dict(seen)["between"].count() < 2000
    days = spark.sql("SELECT date_add(DATE'2020-01-01', CAST(id AS INT)) AS d, CAST(id AS DECIMAL(30, 3)) / 8 AS x FROM range(1001)")
    assert str(order.order_values(days, "d", lambda n: {"m": F.floor((n + 1) / 2)}).first()["m"]) == "2021-05-15"
    assert float(order.order_values(days, "x", lambda n: {"m": F.floor((n + 1) / 2)}).first()["m"]) == 62.5

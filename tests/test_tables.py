import os
import datetime
import glob

import pytest
from pyspark.sql import functions as F

from casewise.functions import parse
from casewise.operators import aggregate as agg
from casewise.operators import clean, profile, relate
from casewise.session import work_path
from casewise.sources import tables as io


def one(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_percent_and_tenure(spark):
    assert one(spark, parse.parse_percent("c"), ["13.5%", " 7 %", "", None, "x%"]) == [13.5, 7.0, None, None, None]
    assert one(spark, parse.parse_tenure("c"), ["< 1 year", "1 year", "10+ years", "n/a", None]) == [0, 1, 10, None, None]


def test_two_digit_years(spark):
    got = one(spark, parse.parse_month_year("c"), ["Dec-11", "Jan-68", "Jan-69", "feb-00", "Xyz-11", None, "Jan"])
    d = datetime.date
    assert got == [d(2011, 12, 1), d(2068, 1, 1), d(1969, 1, 1), d(2000, 2, 1), None, None, None]


def test_mixed_timestamps(spark):
    got = one(spark, parse.parse_mixed_timestamp("c").cast("string"), ["1/2/2016 9:05", "13-07-2016 08:33:16", "soon", None])
    assert got == ["2016-02-01 09:05:00", "2016-07-13 08:33:16", None, None]


def test_words_tokens_truncation(spark):
    assert one(spark, parse.word_count("c"), ["a b", "a  b", "", None]) == [2, 3, 1, None]
    assert one(spark, parse.leading_token("c"), ["alfa-romero giulia", "vw 1", "12"]) == ["alfa", "vw", "12"]
    assert one(spark, parse.truncate_decimals("c"), [1.2399, -1.2399, 0.0], "double") == [1.239, -1.239, 0.0]


def test_helpful_percent(spark):
    assert one(spark, parse.helpful_percent("c"), [[5, 10], [5, 9], [0, 0], [], None], "array<bigint>") == [50.0, None, None, None, None]


def test_flag_keeps_null(spark):
    assert one(spark, parse.derive_flag(F.col("c") == "x"), ["x", "y", None]) == [1, 0, None]


def test_recode_keeps_unlisted_and_null(spark):
    assert one(spark, clean.recode_values("c", {"maxda": "mazda"}), ["maxda", "audi", None]) == ["mazda", "audi", None]


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "c string")
    assert [r[0] for r in clean.binary_encode(df.where("c IS NULL OR c < 'c'"), "c").collect()] == [0, 1, None]
    hot = clean.one_hot_drop_first(df, "c")
    assert hot.columns == ["c_b", "c_c"]
    assert [tuple(r) for r in hot.collect()] == [(1, 0), (0, 0), (None, None), (0, 1)]
    ranks = clean.ordinal_rank(df, "c", "r").collect()
    assert [r["r"] for r in ranks] == [1.2, 1.0, None, 1.4]


def test_ordinal_rank_covers_all_levels(spark):
    grades = [f"{a}{n}" for a in "ABCDEFG" for n in range(1, 6)]
    df = spark.createDataFrame([(g,) for g in grades], "g string")
    ranks = sorted(r["r"] for r in clean.ordinal_rank(df, "g", "r").collect())
    assert len(ranks) == 35 and abs(ranks[-1] - 7.8) < 1e-9


def test_drop_columns(spark):
    df = spark.createDataFrame([(1, None, "k", 1, None), (2, None, "k", None, None)], "a int, b string, c string, d int, e int")
    assert clean.drop_all_null_columns(df).columns == ["a", "c", "d"]
    assert clean.drop_constant_columns(df).columns == ["a", "b", "d", "e"]
    assert clean.drop_constant_columns(df, keep_with_nulls=False).columns == ["a", "b", "e"]


def test_blank_rows_and_dedup(spark):
    df = spark.createDataFrame([("u", 1, 3, 9.0), ("u", 1, 2, 8.0), ("", 1, 1, 7.0), (None, 1, 1, 6.0), (" ", 1, 1, 5.0)], "u string, i int, t int, r double")
    kept = clean.dedup_keep_first(clean.drop_blank_rows(df, ["u"]), ["u", "i"], ["t"])
    assert [tuple(r) for r in kept.collect()] == [("u", 1, 2, 8.0)]


def test_z_score(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (None, 4.0)], "a double, b double")
    got = clean.z_score(df, ["a", "b"]).collect()
    assert [r["a"] is None for r in got] == [False, False, True]
    assert abs(got[1]["a"] - 0.5**0.5) < 1e-12 and got[0]["b"] is None


def test_sum_of_sums_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    assert agg.sum_total(df, ["a", "b"]).first()[0] == 6.0
    assert agg.sum_total(df.where("b IS NULL"), ["a", "b"]).first()[0] is None


def test_cv_of_one_row_group_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, p double")
    got = {r["g"]: r["cv"] for r in agg.group_sum_cv(df, ["g"], ["p"], "p").collect()}
    assert got["a"] is None and abs(got["b"] - 100 * 2**0.5 / 2) < 1e-9


def test_correlation_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.0)], "a double, b double")
    pairwise = {(r["var1"], r["var2"]): r["value"] for r in agg.pair_matrix(df, ["a", "b"]).collect()}
    strict = {(r["var1"], r["var2"]): r["value"] for r in agg.pair_matrix(df, ["a", "b"], nulls="propagate").collect()}
    assert pairwise["a", "b"] == pairwise["b", "a"] and pairwise["a", "b"] > 0.99
    assert strict["a", "b"] is None and abs(strict["a", "a"] - 1) < 1e-12


def test_satisfaction_grains(spark):
    df = spark.createDataFrame([("m", 1, 5.0), ("m", 1, 4.0), ("m", 2, 1.0), ("m", 1, 2.0), ("n", 3, 5.0)], "c string, product int, r double")
    rows = {r["c"]: r for r in agg.satisfaction_ratio(df, "r", ["c"]).collect()}
    items = {r["c"]: r for r in agg.satisfaction_ratio(df, "r", ["c"], "products").collect()}
    assert (rows["m"]["good"], rows["m"]["bad"], rows["n"]["ratio"]) == (2, 2, None)
    assert (items["m"]["good"], items["m"]["bad"]) == (1, 2)


def test_leave_days(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, d(2015, 1, 5)), (1, d(2015, 1, 6)), (2, d(2015, 1, 5)), (1, d(2015, 2, 2))], "e int, day date")
    assert {r["e"]: r["leave_days"] for r in agg.leave_days(df, "e", "day").collect()} == {1: 0, 2: 2}
    monthly = {(r["e"], r["month"].month): r["leave_days"] for r in agg.leave_days(df, "e", "day", by_month=True).collect()}
    assert monthly == {(1, 1): 0, (1, 2): 0, (2, 1): 1, (2, 2): 1}


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, "x"), (None, "X"), (3, "y")], "a int, b string")
    assert {r["column"]: r["nulls"] for r in profile.missing_by_column(df).collect()} == {"a": 1, "b": 0}
    u = profile.key_is_unique(df, "b").first()
    assert (u["rows"], u["distinct_keys"], u["is_unique"]) == (3, 2, False)


def test_threshold_counts_are_taken_before_filtering(spark):
    rows = [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u3", "b")]
    df = spark.createDataFrame(rows, "u string, i string")
    got = {(r["u"], r["i"], r["user_rows"], r["item_rows"]) for r in relate.join_activity_threshold(df, "u", "i", 2, 2).collect()}
    assert got == {("u1", "a", 2, 2), ("u1", "b", 2, 2)}


def test_delimited_round_trip_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, 2.5), (2, "a", None)], "a int, b string, c double")
    path = io.write_delimited(df, work_path(spark, "t"))
    assert sorted(map(tuple, io.read_delimited(spark, path, df.schema).collect())) == [(1, None, 2.5), (2, "a", None)]


def test_partition_filter_reaches_the_scan(spark):
    df = spark.range(100).select("id", (F.col("id") % 5).alias("k"))
    path = io.write_partitioned(df, work_path(spark, "t"), ["k"])
    plan = spark.read.parquet(path).where("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_hot_partition_is_written_by_several_tasks(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    df = spark.range(400_000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 20).alias("k")).repartition(16)
    spark.conf.set(name, "128k")
    try:
        path = io.write_partitioned(df, work_path(spark, "t"), ["k"])
    finally:
        spark.conf.unset(name)
    assert len(glob.glob(f"{path}/k=0/*.parquet")) > 1
    assert spark.read.parquet(path).count() == 400_000


def test_dynamic_overwrite_keeps_other_partitions(spark):
    df = spark.range(100).select("id", (F.col("id") % 5).alias("k"))
    path = io.write_partitioned(df, work_path(spark, "t"), ["k"])
    io.write_partitioned(df.where("k = 2").limit(3), path, ["k"])
    assert spark.read.parquet(path).count() == 83


@pytest.mark.parametrize("parts", [1, 64])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), (F.col("id") * 0.25).alias("v")).repartition(parts)
    assert agg.frequency_of_counts(df, "k").orderBy("rows").collect()[0]["keys"] == 1
    assert agg.mean_median(df, "v").first()["median"] == 124.875


def test_many_levels_take_one_column(spark):
    """Indexes are the places in the order; a hot level and NULLs don't matter; too many values are refused, not collected."""
    rows = [(f"v{i % 3000:04d}",) for i in range(6000)] + [("v0007",)] * 3000 + [(None,)] * 5
    df = spark.createDataFrame(rows, "c string").repartition(7)
    got = clean.level_index(df, "c").groupBy("c", "c_index").count().collect()
    assert {r["c"]: r["c_index"] for r in got} == {None: None, **{f"v{i:04d}": i for i in range(3000)}}
    assert {r["c"]: r["count"] for r in got}["v0007"] == 3002
    with pytest.raises(ValueError, match="more than 1000"):
        clean.one_hot_drop_first(df, "c")
    assert clean.one_hot_drop_first(df, "c", known=["v0000", "v0007"]).columns == ["c_v0007"]
    few = df.where("c < 'v0004' OR c = 'v0007'")
    wide = clean.one_hot_drop_first(few.withColumn("k", F.col("c")), "c")
    names = [c for c in wide.columns if c != "k"]
    indexed = {r["c"]: r["c_index"] for r in clean.level_index(few, "c").distinct().collect()}
    for r in wide.distinct().collect():
        assert [r[n] for n in names] == [int(indexed[r["k"]] == j) for j in range(1, len(names) + 1)]
    assert clean.level_index(df.limit(0), "c").count() == 0


def test_long_pivot_has_the_wide_cells(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 5.0), ("b", "y", 6.0), ("b", None, 9.0), (None, "z", None)], "g string, c string, v double")
    long = {(r["g"], r["c"]): (r["index"], r["value"]) for r in relate.pivot_long(df, ["g"], "c", F.sum("v")).collect()}
    assert long == {("a", "x"): (0, 1.0), ("a", "y"): (1, 2.0), ("b", "y"): (1, 11.0), (None, "z"): (2, None)}
    wide = {r["g"]: r for r in relate.pivot_groups(df, ["g"], "c", ["x", "y", "z"], F.sum("v")).collect()}
    assert all(wide[g][c] == v for (g, c), (_, v) in long.items())


def test_json_lines_are_compressed_in_bounded_files(spark):
    """Nested rows come back equal from compressed files, none of which holds more rows than asked."""
    df = spark.range(0, 2500, 1, 2).select("id", F.when(F.col("id") % 3 > 0, F.array("id", F.lit(None).cast("long"))).alias("a"), F.repeat(F.lit("\u00e9\n\"x"), 40).alias("t"))
    path = io.write_json_lines(df, work_path(spark, "t"), file_rows=500)
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    assert len(files) == 6 and all(f.endswith(".json.gz") for f in files)
    assert sorted(map(tuple, io.read_json_lines(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))

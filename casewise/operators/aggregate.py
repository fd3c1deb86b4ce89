"""Grouped and global aggregates."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from casewise.functions import parse
from casewise.operators import clean
from casewise.operators.cross import pair_matrix
from casewise.operators.order import join_same, quantiles

# Blocks on either side in which data sets are paired.
PAIR_BLOCKS = 16


def count_distinct_exact(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Rows, distinct values and their share in percent.

    The exact form groups first, so the distinct values stay spread over all tasks.
    """
    if approximate:
        counted = df.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(column).alias("distinct_values"))
    else:
        per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
        counted = per_value.agg(F.sum("_c").alias("rows"), F.count(column).alias("distinct_values"))
    return counted.withColumn("distinct_percent", F.try_divide(F.col("distinct_values") * 100.0, F.col("rows")))


def group_count(df: DataFrame, keys: Sequence[str], column: str | None = None, name: str = "rows") -> DataFrame:
    """Rows per key, or non-NULL values of ``column``."""
    return df.groupBy(*keys).agg(F.count(column if column else F.lit(1)).alias(name))


def sum_total(df: DataFrame, measures: Sequence[str], keys: Sequence[str] = (), name: str = "total") -> DataFrame:
    """Sum of column sums: NULLs drop out per column, a column without values makes the total NULL."""
    total = reduce(lambda a, b: a + b, [F.sum(m) for m in measures])
    return df.groupBy(*keys).agg(total.alias(name)) if keys else df.agg(total.alias(name))


def group_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def mean_of_counts(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Average number of rows per key value."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("keys"), F.avg("_c").alias("mean_rows"))


def frequency_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have exactly c rows, with their share of all keys."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    spread = counts.groupBy("rows").agg(F.count(F.lit(1)).alias("keys"))
    total = spread.agg(F.sum("keys").alias("_total"))
    return join_same(spread, total, []).select("rows", "keys", (F.col("keys") * 100 / F.col("_total")).alias("percent"))


def class_share(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("_total"))
    return join_same(counts, total, []).select(column, "rows", (F.col("rows") * 100 / F.col("_total")).alias("percent"))


def variation(column: str) -> Column:
    """Sample deviation as percent of the mean; NULL for one-row groups or a zero mean."""
    return F.try_divide(F.stddev_samp(column) * 100, F.avg(column))


def group_sum_cv(df: DataFrame, keys: Sequence[str], measures: Sequence[str], vary: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures], variation(vary).alias("cv"))


def rank_segments(summary: DataFrame, key: str, profit: str = "profit", cv: str = "cv", best: int = 2) -> DataFrame:
    """The most profitable segments, the steadier one first among equals."""
    return summary.orderBy(F.col(profit).desc(), F.abs(F.col(cv)).asc_nulls_last(), key).limit(best)


def mean_median(df: DataFrame, column: str) -> DataFrame:
    return join_same(df.agg(F.avg(column).alias("mean")), quantiles(df, column, {"median": 0.5}).select("median"), [])


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL if either side is constant there, which the built-in raises on."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def box_stats(df: DataFrame, column: str, by: Sequence[str] = (), method: str = "hinge") -> DataFrame:
    """Whiskers, box edges, median, rows and outlier count, optionally per group."""
    box = clean.box_fences(df, column, by, method)
    edges = box.select(*by, "low_fence", "high_fence")
    inside = F.col(column).between(F.col("low_fence"), F.col("high_fence"))
    fenced = join_same(df.select(*by, column), edges, list(by))
    whiskers = fenced.groupBy(*by).agg(
        F.min(F.when(inside, F.col(column))).alias("low_whisker"),
        F.max(F.when(inside, F.col(column))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
    )
    return join_same(box.drop("low_fence", "high_fence"), whiskers, list(by)).select(
        *by, "n", "low_whisker", "lower", "median", "upper", "high_whisker", "outliers"
    )


def histogram(df: DataFrame, column: str, width: float, origin: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows per left-closed bin."""
    bin_no = parse.fixed_width_bin(column, width, origin).alias("bin")
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, bin_no).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("bin_start", F.lit(origin) + F.col("bin") * F.lit(float(width)))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("rows"))


def fulfilment_rate(df: DataFrame, flag: str, minutes: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of requests met and mean trip time, denominators counted."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(flag).alias("met"),
        F.avg(flag).alias("fulfilment_rate"),
        F.avg(minutes).alias("mean_minutes"),
    )


def category_ratio(df: DataFrame, category: str, metric: Column) -> DataFrame:
    """Ratio of a metric between every two data sets.

    The data sets are reduced to one row each and dealt into ``PAIR_BLOCKS`` blocks; each pair of blocks is a join key of its own, so the
    pairs, which are the result, are spread over the tasks.
    """
    one = df.where(F.col(category).isNotNull()).groupBy(category).agg(metric.alias("m"))
    own, every = F.pmod(F.xxhash64("name"), F.lit(PAIR_BLOCKS)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long")))
    named = one.select(F.col(category).alias("name"), "m")
    left = named.select(F.col("name").alias("category"), F.col("m").alias("m1"), own.alias("a"), every.alias("b"))
    right = named.select(F.col("name").alias("other"), F.col("m").alias("m2"), own.alias("b"), every.alias("a"))
    return left.join(right, ["a", "b"]).where(F.col("category") != F.col("other")).select("category", "other", F.try_divide("m1", "m2").alias("ratio"))


def trend_by_period(df: DataFrame, epoch: str, by: Sequence[str] = (), year: int | None = None) -> DataFrame:
    """Rows per year, or per month inside one year."""
    if year is None:
        return df.groupBy(*by, parse.epoch_year(epoch).alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    # A range on the raw seconds reaches the scan; a function of the column would not.
    start, end = (calendar.timegm((y, 1, 1, 0, 0, 0)) for y in (year, year + 1))
    inside = df.where((F.col(epoch) >= start) & (F.col(epoch) < end))
    return inside.groupBy(*by, parse.epoch_month(epoch).alias("month")).agg(F.count(F.lit(1)).alias("rows"))


def top_products(df: DataFrame, product: str, rating: str, low: float, high: float, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Products with most ratings inside [low, high]."""
    counts = df.where(F.col(rating).between(low, high)).groupBy(*by, product).agg(F.count(F.lit(1)).alias("rows"))
    if not by:
        return counts.orderBy(F.col("rows").desc(), product).limit(n)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.col("rows").desc(), product))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def satisfaction_ratio(df: DataFrame, rating: str, by: Sequence[str], grain: str = "rows", product: str = "product") -> DataFrame:
    """Good (4-5) over bad (1-2) ratings, counted in rows or in distinct products."""
    good, bad = F.col(rating) >= 4, F.col(rating) <= 2
    if grain == "rows":
        sides = df.groupBy(*by).agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    elif grain == "products":
        flags = df.groupBy(*by, product).agg(F.max(good).alias("_g"), F.max(bad).alias("_b"))
        sides = flags.groupBy(*by).agg(F.count_if("_g").alias("good"), F.count_if("_b").alias("bad"))
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return sides.withColumn("ratio", F.try_divide("good", "bad"))


def leave_days(attendance: DataFrame, entity: str, day: str, by_month: bool = False) -> DataFrame:
    """Absent days per entity, in total or per month.

    A day counts as a working day when anybody came; absence is working days less days present,
    so no entity-by-day grid is ever built.
    """
    present = attendance.select(entity, day).distinct()
    month = [F.trunc(day, "month").alias("month")] if by_month else []
    keys = ["month"] if by_month else []
    calendar = present.select(day).distinct().groupBy(*month).agg(F.count(F.lit(1)).alias("_open"))
    came = present.groupBy(entity, *month).agg(F.count(F.lit(1)).alias("_came"))
    if by_month:
        # The calendar has one row per month; entities without any day in a month still get a row.
        months = calendar.agg(F.sort_array(F.collect_list(F.struct("month", "_open"))).alias("_months"))
        grid = join_same(present.select(entity).distinct(), months, []).select(entity, F.explode("_months").alias("_m"))
        joined = grid.select(entity, "_m.*").join(came, [entity, "month"], "left")
    else:
        joined = join_same(came, calendar, keys)
    absent = F.col("_open") - F.coalesce(F.col("_came"), F.lit(0))
    return joined.select(entity, *keys, absent.alias("leave_days"))


def work_hours(attendance: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    return attendance.groupBy(entity).agg(F.avg(parse.duration(start, end, "hours")).alias("mean_hours"))

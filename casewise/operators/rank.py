"""Sorting, top-k and window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from casewise.operators import order
from casewise.operators.order import join_same


def sort_rows(df: DataFrame, order_by: Sequence) -> DataFrame:
    return df.orderBy(*order_by)


def arg_extreme(df: DataFrame, key: str, measure: str, largest: bool = True) -> DataFrame:
    """The row with the smallest or largest measure; ties go to the smaller key."""
    direction = F.col(measure).desc_nulls_last() if largest else F.col(measure).asc_nulls_last()
    return df.orderBy(direction, key).limit(1)


def top_n(df: DataFrame, key: str, measure: str, n: int = 6) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_last(), key).limit(n)


def top_n_with_ties(df: DataFrame, measure: str) -> DataFrame:
    """Every row that shares the largest measure."""
    return join_same(df, df.agg(F.max(measure).alias("_top")), []).where(F.col(measure) == F.col("_top")).drop("_top")


def nth_ranked(df: DataFrame, measure: str, n: int = 2) -> DataFrame:
    """Rows with the n-th largest distinct measure; only n values leave the tasks."""
    values = df.where(F.col(measure).isNotNull()).select(F.col(measure).alias("_v")).distinct()
    top = values.orderBy(F.col("_v").desc()).limit(n)
    nth = top.agg(F.min("_v").alias("_nth"), F.count(F.lit(1)).alias("_found"))
    return join_same(df, nth, []).where((F.col(measure) == F.col("_nth")) & (F.col("_found") == n)).drop("_nth", "_found")


def cumulative_share(df: DataFrame, order_by: Sequence[Column], measure: str) -> DataFrame:
    """Running total and its share of the whole, over a global order."""
    running = order.running_totals(df, order_by, {"running": measure})
    total = df.agg(F.sum(measure).alias("_total"))
    return join_same(running, total, []).withColumn("share", F.try_divide("running", "_total")).drop("_total")


def bucket_ntile(df: DataFrame, order_by: Sequence[Column], groups: int, name: str = "bucket") -> DataFrame:
    """Equal-sized groups by exact rank; the first groups take the surplus rows, as SQL ``ntile`` does."""
    ranked = order.rank_rows(df, order_by, "_rank")
    sized = join_same(ranked, df.agg(F.count(F.lit(1)).alias("_n")), [])
    small = F.floor(F.col("_n") / groups)
    extra = F.col("_n") % groups
    big_rows = extra * (small + 1)
    place = F.when(F.col("_rank") <= big_rows, F.ceil(F.col("_rank") / (small + 1))).otherwise(
        extra + F.ceil(F.try_divide(F.col("_rank") - big_rows, small))
    )
    return sized.withColumn(name, place.cast("long")).drop("_rank", "_n")


def moving_average(df: DataFrame, series: str, t: str, value: str, width: int, name: str = "smoothed") -> DataFrame:
    """Centred mean of ``width`` points; NULL where the frame is not full."""
    after = width // 2
    before = width - 1 - after
    frame = W.partitionBy(series).orderBy(t).rowsBetween(-before, after)
    full = F.count(F.lit(1)).over(frame) == width
    return df.withColumn(name, F.when(full, F.avg(value).over(frame)))


def edge_extrapolation(df: DataFrame, series: str, t: str, smoothed: str, width: int) -> DataFrame:
    """Replace the first and last ``width`` points by straight lines through the nearest two inner points.

    Series shorter than ``2 * width + 2`` get NULL edges.
    """
    whole = W.partitionBy(series)
    n = F.count(F.lit(1)).over(whole)

    def at(position):
        return F.max(F.when(F.col(t) == position, F.col(smoothed))).over(whole)

    anchored = df.withColumn("_n", n)
    size = F.col("_n")
    anchored = anchored.withColumns({
        "_l0": at(F.lit(width + 1)), "_l1": at(F.lit(width + 2)),
        "_r0": at(size - width), "_r1": at(size - width - 1),
    })
    left = F.col("_l0") - (width + 1 - F.col(t)) * (F.col("_l1") - F.col("_l0"))
    right = F.col("_r0") + (F.col(t) - size + width) * (F.col("_r0") - F.col("_r1"))
    long_enough = size >= 2 * width + 2
    filled = (
        F.when((F.col(t) <= width) & long_enough, left)
        .when((F.col(t) > size - width) & long_enough, right)
        .when((F.col(t) > width) & (F.col(t) <= size - width), F.col(smoothed))
    )
    return anchored.withColumn(smoothed, filled).select(*df.columns)

"""Joins and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.operators.clean import level_index


def join_collate(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Inner join of all tables on one key."""
    return reduce(lambda left, right: left.join(right, key, "inner"), tables)


def join_activity_threshold(
    facts: DataFrame, user: str, item: str, min_user: int, min_item: int
) -> DataFrame:
    """Facts whose user and item are active enough, with both counts attached.

    Both counts are taken on the unfiltered facts.
    """
    items = facts.groupBy(item).agg(F.count(F.lit(1)).alias("item_rows")).where(F.col("item_rows") >= min_item)
    users = facts.groupBy(user).agg(F.count(F.lit(1)).alias("user_rows")).where(F.col("user_rows") >= min_user)
    return facts.join(items, item).join(users, user)


def attach_by_key(facts: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Add columns of ``other`` by key; facts without a match keep NULL."""
    return facts.join(other.select(key, *columns), key, "left")


def unpivot_wide(wide: DataFrame, ids: Sequence[str], name: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns -> rows (id, name, value)."""
    columns = list(columns or [c for c in wide.columns if c not in ids])
    return wide.unpivot(list(ids), columns, name, value)


def pivot_groups(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, measure: Column) -> DataFrame:
    """One column per listed group value."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(measure)


def pivot_long(df: DataFrame, rows: Sequence[str], column: str, measure: Column, name: str = "value") -> DataFrame:
    """The cells of ``pivot_groups`` for any number of values: one row per group and value that occurs, with the value's ``index`` among all.

    The long form has as many rows as filled cells; a value of NULL has no column and no row.
    """
    cells = df.where(F.col(column).isNotNull()).groupBy(*rows, column).agg(measure.alias(name))
    return level_index(cells, column, "index")

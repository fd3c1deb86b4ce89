"""Table profiles: each is one aggregate over all columns, turned into rows afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators import order


def _per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """Run every measure on every column in one pass; one output row per column."""
    packed = [
        F.struct(F.lit(c).alias("column"), *[make(F.col(c)).alias(n) for n, make in measures.items()]) for c in columns
    ]
    return df.agg(F.array(*packed).alias("_all")).select(F.explode("_all").alias("_one")).select("_one.*")


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, nulls, min, quartiles, mean and max per column."""
    basic = _per_column(
        df,
        columns,
        {
            "n": F.count,
            "nulls": lambda c: F.count_if(c.isNull()),
            "min": lambda c: F.min(c).cast("double"),
            "mean": F.avg,
            "max": lambda c: F.max(c).cast("double"),
        },
    )
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    boxes = order.quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"])
    return basic.join(boxes.drop("n"), "column", "left").select(
        "column", "n", "nulls", "min", "q1", "median", "mean", "q3", "max"
    )


def profile_schema(df: DataFrame) -> DataFrame:
    """Column position, name and type with the number of rows."""
    names = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema.fields, 1)
    ])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(names).alias("_f"), "rows").select("_f.*", "rows")


def head_rows(df: DataFrame, order_by: Sequence, n: int = 6) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _per_column(
        df,
        list(columns or df.columns),
        {
            "nulls": lambda c: F.count_if(c.isNull()),
            "null_percent": lambda c: F.try_divide(F.count_if(c.isNull()) * 100.0, F.count(F.lit(1))),
        },
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Keys (default: whole rows) that occur more than once."""
    return df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def key_is_unique(df: DataFrame, key: str) -> DataFrame:
    """Row count, distinct case-folded keys, and whether they agree."""
    folded = df.groupBy(F.lower(F.col(key).cast("string")).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    return folded.agg(
        F.sum("_c").alias("rows"), F.count("_k").alias("distinct_keys")
    ).withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))


def key_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Levels and their frequency for every categorical column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "level")
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("rows"))

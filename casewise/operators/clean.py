"""Filtering, de-duplication, recoding and column clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from casewise.operators import order
from casewise.operators.order import join_same

# Values of a column that may become columns without being named.
MOST_LEVELS = 1000


def drop_blank_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all neither NULL nor blank."""
    for key in keys:
        df = df.where(F.trim(F.col(key)) != "")
    return df


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value; one pass over the table."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def drop_constant_columns(df: DataFrame, keep_with_nulls: bool = True) -> DataFrame:
    """Drop columns with one single value; one pass over the table.

    With ``keep_with_nulls`` a column that also holds NULLs counts as varying.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    for c in df.columns:
        measures += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}")]
    seen = df.agg(*measures).first()

    def constant(c):
        full = seen[f"n_{c}"] == seen["rows"] or not keep_with_nulls
        return full and seen[f"n_{c}"] > 0 and seen[f"lo_{c}"] == seen[f"hi_{c}"]

    return df.drop(*[c for c in df.columns if constant(c)])


def dedup_keep_first(df: DataFrame, keys: Sequence[str], first_by: Sequence[str]) -> DataFrame:
    """One row per key: the first under ``first_by``, remaining columns breaking ties.

    A minimum over a struct combines on the map side, so a key with very many copies is no hot task.
    """
    rest = [c for c in df.columns if c not in keys and c not in first_by]
    ranked = F.struct(*[F.col(c) for c in [*first_by, *rest]])
    return df.groupBy(*keys).agg(F.min(ranked).alias("_first")).select(*keys, "_first.*").select(*df.columns)


def recode_values(column: str, mapping: dict[str, str]) -> Column:
    """Replace listed values; others stay."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.get(F.array(F.create_map(*pairs)[F.col(column)]), 0), F.col(column))


def fill_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def outlier_to_null(df: DataFrame, column: str, method: str = "hinge") -> DataFrame:
    """Values beyond 1.5 box widths become NULL."""
    fences = box_fences(df, column, method=method).select("low_fence", "high_fence")
    inside = F.col(column).between(F.col("low_fence"), F.col("high_fence"))
    return join_same(df, fences, []).withColumn(column, F.when(inside, F.col(column))).drop("low_fence", "high_fence")


def outlier_report(df: DataFrame, column: str, method: str = "hinge") -> DataFrame:
    """Outlier count and share, mean with and without outliers and mean of the outliers."""
    fences = box_fences(df, column, method=method).select("low_fence", "high_fence")
    inside = F.col(column).between(F.col("low_fence"), F.col("high_fence"))
    return join_same(df.select(column), fences, []).agg(
        F.count_if(~inside).alias("outliers"),
        (F.count_if(~inside) * 100 / F.count(column)).alias("outlier_percent"),
        F.avg(F.when(~inside, F.col(column))).alias("mean_outliers"),
        F.avg(column).alias("mean_before"),
        F.avg(F.when(inside, F.col(column))).alias("mean_after"),
    )


def box_fences(df: DataFrame, column: str, by: Sequence[str] = (), method: str = "hinge") -> DataFrame:
    """Box edges, median and the fences 1.5 box widths outside: ``method`` is hinge or type7."""
    if method == "hinge":
        box = order.hinges(df, column, by)
    elif method == "type7":
        box = order.quantiles(df, column, {"lower": 0.25, "median": 0.5, "upper": 0.75}, by)
    else:
        raise ValueError(f"unknown box method {method!r}")
    reach = (F.col("upper") - F.col("lower")) * 1.5
    return box.withColumn("low_fence", F.col("lower") - reach).withColumn("high_fence", F.col("upper") + reach)


def select_numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Convert columns; values that do not fit become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def cast_losses(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """How many values each conversion would turn into NULL."""
    lost = [
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()
    ]
    return df.agg(*lost).unpivot([], list(types), "column", "lost")


def row_slice(df: DataFrame, order_by: Sequence[Column], skip: int = 0, every: int = 1) -> DataFrame:
    """Positional subset under a total order: leave out ``skip`` rows, then take every ``every``-th."""
    ranked = order.rank_rows(df, order_by, "_position")
    place = F.col("_position") - skip
    return ranked.where((place > 0) & ((place - 1) % every == 0)).drop("_position")


def levels(df: DataFrame, column: str, at_most: int = MOST_LEVELS) -> list:
    """Sorted distinct non-NULL values, for results that have a column for each.

    More than ``at_most`` values are refused before they reach the driver: such a column wants ``level_index`` or a stated list.
    """
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(at_most + 1).collect()
    if len(found) > at_most:
        raise ValueError(f"{column} has more than {at_most} values; use level_index, or name the values")
    return sorted(r[0] for r in found)


def level_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(``column``, ``index``): the non-NULL values in their order, from 0; a range sort, however many they are."""
    known = df.select(column).where(F.col(column).isNotNull()).distinct()
    return order.rank_rows(known, [F.col(column)], "index").withColumn("index", F.col("index") - 1)


def level_index(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Indicators of any number of levels in one column: the level's index, 0 for the baseline that indicator columns leave out, NULL for NULL.

    It is the sparse form of ``one_hot_drop_first``: index j is a 1 in its j-th column.
    """
    places = level_dictionary(df, column).select(F.col(column).alias("_level"), F.col("index").alias("_index"))
    joined = df.join(places, F.col(column) == F.col("_level"), "left")
    return joined.withColumn(name or f"{column}_index", F.col("_index")).drop("_level", "_index")


def z_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise with the table's mean and sample deviation; NULLs are left out and stay NULL."""
    measures = []
    for c in columns:
        measures += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    joined = join_same(df, df.agg(*measures), [])
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def binary_encode(df: DataFrame, column: str) -> DataFrame:
    """1 for the alphabetically first level, 0 for the other."""
    return join_same(df, df.agg(F.min(column).alias("_first")), []).withColumn(
        column, F.when(F.col(column) == F.col("_first"), 1).when(F.col(column).isNotNull(), 0)
    ).drop("_first")


def one_hot_drop_first(df: DataFrame, column: str, known: Sequence[str] | None = None) -> DataFrame:
    """0/1 columns for every level but the first; the text column is dropped."""
    names = list(known) if known is not None else levels(df, column)
    flags = {f"{column}_{name}": F.when(F.col(column) == name, 1).when(F.col(column).isNotNull(), 0) for name in names[1:]}
    return df.withColumns(flags).drop(column)


def ordinal_rank(df: DataFrame, column: str, name: str, start: float = 1.0, step: float = 0.2) -> DataFrame:
    """Evenly spaced number per level, in alphabetical order."""
    known = df.select(F.col(column).alias("_level")).where(F.col("_level").isNotNull()).distinct()
    places = order.rank_rows(known, [F.col("_level")], "_place")
    joined = df.join(places, F.col(column) == F.col("_level"), "left")
    return joined.withColumn(name, F.lit(start) + (F.col("_place") - 1) * step).drop("_level", "_place")

"""Masked cross products: everything pairwise statistics of many columns need, in one pass.

With ``X`` the values (missing ones zero) and ``M`` their marks, a task adds up ``M'M``, ``X'M``, ``(X*X)'M`` and ``X'X`` block by block of rows,
one matrix product each, whatever is missing where. One row per column travels; Spark adds the rows of the tasks and unfolds the pairs. No
expression per pair is planned and nothing comes to the driver but one provisional mean per column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows from which the provisional means come. They only keep the sums small; any value gives the same result up to rounding.
HEAD_ROWS = 1000
# A variance below this share of the mean square about the provisional mean is rounding: the column is constant there.
CONSTANT = 1e-12
# Arrays of a row, each over the columns from its own on: pairs, sums and sums of squares of either side, products.
PARTS = ("n", "x", "y", "xx", "yy", "xy")


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def _matrix(batch: pa.RecordBatch, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.empty((batch.num_rows, batch.num_columns))
    for i, column in enumerate(batch.columns):
        values[:, i] = column.to_numpy(zero_copy_only=False)
    present = np.isfinite(values)
    return np.where(present, values - shift, 0.0), present.astype(float)


def pair_sums(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """One row per column number ``i``: ``rows``, and the arrays ``PARTS`` over the columns ``i``, ``i + 1``, ...; and the shift taken off each column.

    Missing are NULL, NaN and infinite values.
    """
    p, numbers = len(columns), _numbers(df, columns)
    finite = [F.when(F.abs(F.col(f"c{i}")) < float("inf"), F.col(f"c{i}")) for i in range(p)]
    means = numbers.limit(HEAD_ROWS).agg(*[F.avg(x).alias(f"c{i}") for i, x in enumerate(finite)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means], float)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((len(PARTS), p, p)), 0
        for batch in batches:
            x, m = _matrix(batch, shift)
            rows += len(x)
            sums, squares = x.T @ m, (x * x).T @ m
            for k, part in enumerate((m.T @ m, sums, sums.T, squares, squares.T, x.T @ x)):
                total[k] += part
        if rows:
            packed = pa.array([np.append(total[:, i, i:].ravel(), rows) for i in range(p)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p), pa.int32()), packed], ["i", "sums"])

    added = numbers.mapInArrow(add_up, "i int, sums array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    sums, width = vector_to_array("sums"), F.lit(p) - F.col("i")
    parts = [F.slice("sums", F.lit(k) * width + 1, width).alias(name) for k, name in enumerate(PARTS)]
    return added.select("i", sums.alias("sums")).select("i", F.element_at("sums", -1).alias("rows"), *parts), shift


def pair_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (i, j, rows, n, var1, var2, cov), i <= j: complete pairs, and over them the sample variances and covariance; NULL below two pairs.

    A column that is constant over the pairs has variance and covariance zero.
    """
    sums, _ = pair_sums(df, columns)
    one = sums.select("i", "rows", F.posexplode(F.arrays_zip(*PARTS)).alias("at", "s")).select("i", (F.col("i") + F.col("at")).alias("j"), "rows", "s.*")

    def centred(square: str, a: str, b: str):
        return F.col(square) - F.try_divide(F.col(a) * F.col(b), F.col("n"))

    def variance(square: str, a: str):
        spread = centred(square, a, a)
        return F.when(spread > CONSTANT * F.col(square), spread).otherwise(0.0)

    free = F.when(F.col("n") >= 2, F.col("n") - 1)
    both = one.withColumns({"var1": F.try_divide(variance("xx", "x"), free), "var2": F.try_divide(variance("yy", "y"), free)})
    cov = F.when((F.col("var1") > 0) & (F.col("var2") > 0), F.try_divide(centred("xy", "x", "y"), free)).otherwise(F.col("var1") * 0.0)
    return both.select("i", "j", F.col("rows").cast("long"), F.col("n").cast("long"), "var1", "var2", cov.alias("cov"))


def pair_matrix(df: DataFrame, columns: Sequence[str], kind: str = "corr", nulls: str = "pairwise") -> DataFrame:
    """Correlation or covariance of every pair as rows (var1, var2, value); of a constant column the correlation is NULL."""
    columns = list(columns)
    stats = pair_statistics(df, columns)
    corr = F.when(F.col("i") == F.col("j"), F.when(F.col("var1") > 0, 1.0)).otherwise(F.try_divide("cov", F.sqrt(F.col("var1") * F.col("var2"))))
    value = {"corr": F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0)), "cov": F.when(F.col("i") == F.col("j"), F.col("var1")).otherwise(F.col("cov"))}[kind]
    if nulls == "propagate":
        value = F.when(F.col("n") == F.col("rows"), value)
    # ``least`` and ``greatest`` skip NULLs, so a missing correlation is restored.
    value = F.when(corr.isNotNull(), value) if kind == "corr" else value
    name = lambda at: F.element_at(F.array(*map(F.lit, columns)), F.col(at) + 1)
    upper = stats.select(name("i").alias("var1"), name("j").alias("var2"), value.alias("value"), (F.col("i") == F.col("j")).alias("same"))
    sides = F.array(F.struct("var1", "var2"), F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2")))
    return upper.select(F.explode(F.when(F.col("same"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s"), "value").select("s.*", "value")

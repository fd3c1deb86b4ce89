"""Leading principal components of wide vectors, without a width-by-width matrix.

A random block of directions is multiplied by the data and back, pass by pass, until the variances along it stand still; each pass is one job in which
a task reads its rows once and returns ``width x block`` numbers. The rows' coordinates along the block are then reduced by a tree of QR
factorisations, a small triangle per task and per group of tasks, whose singular values and vectors are the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERSAMPLE, PASSES, STILL, SEED = 10, 60, 1e-12, 100
# Triangles that one task of the tree joins, on average.
BRANCHES = 64


@dataclass
class Components:
    """``vectors`` has a column per component; ``share`` is of the variance of all dimensions."""

    n: int
    mean: np.ndarray
    vectors: np.ndarray
    variance: np.ndarray
    share: np.ndarray


def _rows(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("array<double>").alias("v")).where(F.col("v").isNotNull())


def _per_task(rows: DataFrame, centre: np.ndarray, make: Callable[[Iterator[np.ndarray]], np.ndarray]) -> DataFrame:
    """One row (``part``, ``m``) per line of the matrix that ``make`` gets from a task's centred rows, ``m`` being the line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = make(np.stack(b["v"].to_numpy()) - centre for b in batches if len(b))
        if matrix is not None and len(matrix):
            yield pd.DataFrame({"part": np.arange(len(matrix), dtype="int32"), "m": list(matrix)})

    return rows.mapInPandas(run, "part int, m array<double>")


def _multiplied(rows: DataFrame, centre: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The data's cross products with the block: transposed rows times rows times block."""

    def make(parts):
        total = None
        for x in parts:
            total = (0 if total is None else total) + (x @ block).T @ x
        return total

    added = _per_task(rows, centre, make).groupBy("part").agg(Summarizer.sum(array_to_vector("m")).alias("s"))
    lines = {r["part"]: r["s"].toArray() for r in added.collect()}  # width x block numbers
    return np.stack([lines[i] for i in range(block.shape[1])], axis=1)


def _triangle(rows: DataFrame, centre: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The triangle of the QR factorisation of the rows' coordinates along the block, by a tree."""
    width = block.shape[1]

    def factor(parts):
        r = np.zeros((0, width))
        for x in parts:
            r = np.linalg.qr(np.vstack([r, x @ block]), mode="r")
        return r

    def join(group: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.stack(group["m"].to_numpy()), mode="r")
        return pd.DataFrame({"m": list(r)})

    leaves = _per_task(rows, centre, factor).withColumn("branch", F.spark_partition_id() % BRANCHES)
    joined = leaves.groupBy("branch").applyInPandas(join, "m array<double>")
    lines = [r["m"] for r in joined.collect()]  # at most a triangle a branch
    return np.linalg.qr(np.array(lines), mode="r")


def leading_components(df: DataFrame, column: str, k: int, passes: int = PASSES, seed: int = SEED) -> Components | None:
    """The ``k`` components of largest variance of the centred vectors; None without vectors.

    Vectors are of one length; NULL vectors are left out. Fewer components come back where the rows or dimensions don't give ``k``. Each vector's largest
    entry is positive. Repeated passes stop when no variance among the ``k`` moves any more.
    """
    rows = _rows(df, column)
    if rows.isEmpty():
        return None
    summary = rows.select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("v")).alias("s")).first()
    n, centre = int(summary["s"]["count"]), summary["s"]["mean"].toArray()
    every = float(summary["s"]["variance"].toArray().sum())
    size = min(k + OVERSAMPLE, len(centre))
    block, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(centre), size)))
    before = np.zeros(size)
    for _ in range(passes):
        product = _multiplied(rows, centre, block)
        found = np.sort(np.linalg.eigvalsh((block.T @ product + product.T @ block) / 2))[::-1]
        block, _ = np.linalg.qr(product)
        if np.abs(found - before)[:k].max() <= STILL * max(found[0], 1e-300):
            break
        before = found
    _, sigma, turn = np.linalg.svd(_triangle(rows, centre, block), full_matrices=False)
    k = min(k, len(sigma), max(n - 1, 1))
    vectors = block @ turn[:k].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    variance = sigma[:k] ** 2 / max(n - 1, 1)
    return Components(n, centre, vectors, variance, variance / every if every > 0 else np.full(k, np.nan))


def project(df: DataFrame, column: str, found: Components, name: str = "projected") -> DataFrame:
    """The vectors' coordinates along the components, centred; NULL stays NULL."""
    mean, vectors = found.mean, found.vectors

    @F.pandas_udf("array<double>")
    def along(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known, out = np.flatnonzero(batch.notna()), np.full(len(batch), None, object)
            for i, x in zip(known, (np.stack(batch.iloc[known].to_numpy()) - mean) @ vectors if len(known) else ()):
                out[i] = x
            yield pd.Series(out)

    return df.withColumn(name, along(F.col(column).cast("array<double>")))

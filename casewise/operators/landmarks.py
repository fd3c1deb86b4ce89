"""Kernel features from landmarks: a pivoted Cholesky factorisation of the radial kernel, its pivots chosen over all rows.

A row's residual is what the landmarks so far leave unexplained of its own kernel value. In every round each row draws a number that is the smaller the
larger its residual (an exponential race, from the hash of its key), and the smallest draws of the whole table are candidates: rows in
proportion to their residual. One job a round; a task reads its rows once and returns at most a block of them. Among the candidates the pivots are then taken in
order of residual, until what is left of the block is a small share, so near copies of one row don't become landmarks twice. The features' inner products are the
kernel projected on the landmarks, the best approximation that these rows allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.functions.hashing import SPAN, key_hash

BLOCK, SEED = 48, 100
# A residual below this is rounding.
NOTHING = 1e-9


@dataclass
class Landmarks:
    """``points`` has a landmark per row, ``root`` is the lower triangle of their kernel's Cholesky factorisation."""

    points: np.ndarray
    root: np.ndarray
    gamma: float

    def kernel(self, x: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1)[None] - 2.0 * x @ self.points.T
        return np.exp(-self.gamma * np.maximum(squares, 0.0))

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.root, self.kernel(x).T).T if len(self.points) else np.zeros((len(x), 0))

    def residual(self, x: np.ndarray) -> np.ndarray:
        return 1.0 - (self.features(x) ** 2).sum(1)


def _extend(found: Landmarks, x: np.ndarray, count: int) -> Landmarks:
    """``found`` with pivots among the candidates ``x``, by residual, until a fraction of one candidate's share is left or ``count`` is reached."""
    near = Landmarks(x, np.zeros((0, 0)), found.gamma).kernel(x)
    rows = found.features(x)
    left, start = 1.0 - (rows**2).sum(1), None
    points, root = found.points, found.root
    while len(points) < count:
        i = int(left.argmax())
        total = float(np.maximum(left, 0.0).sum())
        start = total if start is None else start
        if left[i] <= NOTHING or (total < start / len(x) and len(points) > len(found.points)):
            break
        pivot = np.sqrt(left[i])
        column = (near[:, i] - rows @ rows[i]) / pivot
        wider = np.zeros((len(points) + 1, len(points) + 1))
        wider[:-1, :-1], wider[-1, :-1], wider[-1, -1] = root, rows[i], pivot
        points, root = np.vstack([points, x[i]]), wider
        rows = np.hstack([rows, column[:, None]])
        left = left - column**2
        left[i] = 0.0
    return Landmarks(points, root, found.gamma)


def choose(df: DataFrame, key: str, array_col: str, count: int, gamma: float, block: int = BLOCK, seed: int = SEED) -> Landmarks | None:
    """Up to ``count`` landmarks among the rows; fewer where the rows' kernel has no more rank. None without vectors.

    Vectors are of one length; NULL vectors and those with NULL or non-finite values are never landmarks. The choice depends on keys and vectors only, not on partitions,
    if keys are unique; of rows with equal keys any may come first."""
    x = F.col(array_col).cast("array<double>")
    rows = df.select(F.col(key).alias("k"), x.alias("v")).where(
        F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    first = rows.select(F.size("v")).first()
    if first is None:
        return None
    found = Landmarks(np.zeros((0, first[0])), np.zeros((0, 0)), gamma)
    kind = rows.schema["k"].dataType.simpleString()
    for round_ in range(count):  # every round adds at least one
        drawn = rows.select("k", "v", ((key_hash(seed + round_, "k") + 1) / F.lit(SPAN + 1.0)).alias("u"))

        def race(batches: Iterator[pd.DataFrame], found=found) -> Iterator[pd.DataFrame]:
            kept = None
            for b in batches:
                if not len(b):
                    continue
                left = found.residual(np.stack(b["v"].to_numpy()))
                some = left > NOTHING
                fast = pd.DataFrame({"k": b["k"][some], "v": b["v"][some], "draw": -np.log(b["u"][some]) / left[some]})
                kept = (fast if kept is None else pd.concat([kept, fast])).sort_values(["draw", "k"]).head(block)
            if kept is not None and len(kept):
                yield kept

        raced = drawn.mapInPandas(race, f"k {kind}, v array<double>, draw double")
        some = raced.orderBy("draw", "k").limit(block).collect()  # at most a block
        if not some:
            break
        before, found = len(found.points), _extend(found, np.array([r["v"] for r in some]), count)
        if len(found.points) in (before, count):
            break
    return found


def features(df: DataFrame, array_col: str, found: Landmarks, name: str = "_features") -> DataFrame:
    """``df`` with the vectors' kernel features, one solve per batch; NULL vectors have NULL features."""

    @F.pandas_udf("array<double>")
    def along(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known, out = np.flatnonzero(batch.notna()), np.full(len(batch), None, object)
            for i, x in zip(known, found.features(np.stack(batch.iloc[known].to_numpy())) if len(known) else ()):
                out[i] = x
            yield pd.Series(out)

    mapped = along(F.col(array_col).cast("array<double>"))
    return df.withColumn(name, F.when(F.col(array_col).isNotNull(), array_to_vector(mapped)))

"""Exact top-k search by inner product with a vector-approximation file.

Components are whole numbers, ``floor(64 x)``. The approximation file holds each vector as one small cell number per dimension. A block of
queries scans it block by block: with a vector's cells known, its score lies within ``q·middle ± |q|·radius``, so only vectors
whose upper bound reaches the k-th best lower bound seen so far stay. Of those, exact vectors are read in the order of their bounds: first the most
promising, then only those whose bound still reaches the k-th exact score; no other can enter the result.

Equal vectors form one class, scanned once, with its k + 1 smallest ids (a query never finds itself, so no more can be needed). Hence a
vector that a third of all rows share costs no more than any other.

The queries are a stated set, and every query block meets every block of the file: work is queries x classes, in blocks of fixed
size. Vectors that are null, empty, or hold null or non-finite components take no part; vectors of another length are not compared with a
query. Equal scores go to the smaller id. Rows with a null id are no candidates; equal rows count once; if an id is repeated with other
vectors, each is a candidate and the largest vector is the query. Components beyond ``LARGEST`` in size count as ``LARGEST``. Scores are exact and
ranked as such, whatever their size; one that no 64-bit number holds is given as null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import cut

SCALE, TOP = 64, 20
CELLS = 256  # a byte for each dimension; whole numbers that span less have a cell each, so their bounds are exact
LARGEST = 1 << 56
ROUNDING = 2.0**-46  # of the largest possible score, on either side of a bound that floating point works out
BLOCK_ROWS, QUERY_ROWS, CHUNK = 65_536, 1024, 2048


def whole_vector(vector: Column) -> Column:
    """``floor(64 x)`` per component; null unless all components are finite numbers."""
    fine = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, whole))


def inner_product(a: Column, b: Column) -> Column:
    """Exact, as a decimal; summed in 64 bits where that is certain to hold it."""
    greatest = lambda v: F.array_max(F.transform(v, F.abs)).cast("double")
    wide = "decimal(38,0)"
    in_long = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x).cast(wide)
    in_decimal = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("decimal(18,0)") * y.cast("decimal(18,0)")).cast(wide)), F.lit(0).cast(wide), lambda s, x: (s + x).cast(wide))
    return F.when(greatest(a) * greatest(b) * F.size(a) < 2.0**62, in_long).otherwise(in_decimal)


def classes(vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """One row per distinct vector: ``class`` (its smallest id), ``v``, ``n`` (dimensions) and its ``ids``, the k + 1 smallest."""
    rows = vectors.select(vectors[key].alias("id"), whole_vector(vectors[vector]).alias("v")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    few = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.min("id").alias("class"), F.array_sort(F.collect_list("id")).alias("ids")).withColumn("n", F.size("v"))


def cell_marks(found: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length, the least value and the cell width of each dimension. Comes to the driver: a row per length and dimension."""
    ends = found.select("n", F.posexplode("v").alias("d", "x")).groupBy("n", "d").agg(F.min("x").alias("low"), F.max("x").alias("high")).toPandas()
    out = {}
    for n, rows in ends.groupby("n"):
        rows = rows.sort_values("d")
        low, high = rows["low"].to_numpy(np.int64), rows["high"].to_numpy(np.int64)
        out[int(n)] = low, (high - low) // CELLS + 1
    return out


def approximation_file(found: DataFrame, marks: dict) -> DataFrame:
    """Blocks of at most about ``BLOCK_ROWS`` vectors of one length: their classes and cell numbers, packed."""
    blocks = max(1, -(-found.count() // BLOCK_ROWS))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        low, width = marks[int(rows["n"].iloc[0])]
        cells = (np.array(rows["v"].tolist(), np.int64) - low) // width
        return pd.DataFrame({"n": rows["n"].iloc[:1], "block": rows["block"].iloc[:1], "classes": [rows["class"].to_numpy(np.int64).tobytes()],
                             "cells": [cells.astype(np.uint8).tobytes()]})

    dealt = found.select("n", "class", "v", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("n", "block").applyInPandas(pack, "n int, block int, classes binary, cells binary")


def query_blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    count = max(1, -(-queries.count() // QUERY_ROWS))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": rows["n"].iloc[:1], "group": rows["group"].iloc[:1], "queries": [rows["query"].to_numpy(np.int64).tobytes()],
                             "points": [np.array(rows["q"].tolist(), np.int64).tobytes()]})

    dealt = queries.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(count)).cast("int"))
    return dealt.groupBy("n", "group").applyInPandas(pack, "n int, group int, queries binary, points binary"), count


def scan(points: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
    """Bounds of all points against a block; yields (query, vector, lower, upper) arrays of those that may be among the k best.

    The threshold of a query is the k-th best lower bound so far; candidates of earlier chunks are tested again at the end."""
    best = np.full((len(points), k), -np.inf)
    size, kept = np.abs(points).astype(np.float64), []
    exact = points.astype(np.float64)
    for start in range(0, len(cells), CHUNK):
        part = cells[start : start + CHUNK].astype(np.float64)
        first = low + part * width
        middle, radius = (first + (width - 1) / 2).T, np.broadcast_to((width - 1) / 2, part.shape).T
        centre, reach = exact @ middle, size @ radius
        reach = reach + size @ (np.maximum(np.abs(first), np.abs(first + width)).T * ROUNDING)
        lower, upper = centre - reach, centre + reach
        both = np.concatenate([best, lower], axis=1)
        best = -np.partition(-both, k - 1, axis=1)[:, :k]
        q, v = np.nonzero(upper >= best[:, -1:])
        kept.append((q, v + start, lower[q, v], upper[q, v]))
    if not kept:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),) * 2
    q, v, lower, upper = (np.concatenate(x) for x in zip(*kept))
    still = upper >= best[q].min(axis=1)
    return q[still], v[still], lower[still], upper[still]


def candidates(file: DataFrame, queries: DataFrame, marks: dict, k: int) -> DataFrame:
    """(query, class, lower, upper) that the scan of each block leaves."""
    blocks, count = query_blocks(queries)
    pairs = file.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(blocks, ["n", "group"])

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                low, width = marks[int(row.n)]
                points = np.frombuffer(row.points, np.int64).reshape(-1, row.n)
                q, v, lower, upper = scan(points, np.frombuffer(row.cells, np.uint8).reshape(-1, row.n), low, width, k)
                yield pd.DataFrame({"query": np.frombuffer(row.queries, np.int64)[q], "class": np.frombuffer(row.classes, np.int64)[v],
                                    "lower": lower, "upper": upper})

    # One pair of blocks at a time: a few megabytes each.
    return pairs.repartition(F.col("group"), F.col("block")).mapInPandas(run, "query long, class long, lower double, upper double")


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP) -> DataFrame:
    """The ``k`` best other rows for every row that ``is_query`` selects: query_id, rank, vec_id, score."""
    found = cut(classes(vectors, key, vector, k))
    queries = cut(vectors.filter(is_query).select(vectors[key].alias("query"), whole_vector(vectors[vector]).alias("q")).filter(
        F.col("q").isNotNull() & F.col("query").isNotNull()).groupBy("query").agg(F.max("q").alias("q")).withColumn("n", F.size("q")))
    marks = cell_marks(found)
    by_query = Window.partitionBy("query")
    near = candidates(approximation_file(found, marks), queries, marks, k + 1)
    # Over all blocks: the (k + 1)-th best lower bound, as one candidate may be the query itself.
    place = F.row_number().over(by_query.orderBy(F.col("lower").desc(), "class"))
    near = near.withColumn("place", place).withColumn("floor", F.max(F.when(F.col("place") == k + 1, F.col("lower"))).over(by_query))
    near = near.filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    near = cut(near.select("query", "class", "upper", F.row_number().over(by_query.orderBy(F.col("upper").desc(), "class")).alias("turn")))

    def read(chosen: DataFrame) -> DataFrame:
        return chosen.join(found.select("class", "n", "v", "ids"), "class").join(queries, ["query", "n"]).select("query", "ids", inner_product(F.col("q"), F.col("v")).alias("score"))

    first = cut(read(near.filter(F.col("turn") <= 2 * (k + 1)).select("query", "class")))
    certain = first.withColumn("place", F.row_number().over(by_query.orderBy(F.col("score").desc()))).filter(F.col("place") == k + 1)
    later = near.filter(F.col("turn") > 2 * (k + 1)).join(certain.select("query", F.col("score").alias("reached")), "query").filter(F.col("upper") >= F.col("reached").cast("double"))
    scored = first.unionByName(read(later.select("query", "class")))
    each = scored.select("query", "score", F.explode("ids").alias("id")).filter(F.col("id") != F.col("query"))
    ranked = each.withColumn("rank", F.row_number().over(by_query.orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.expr("try_cast(score AS bigint)").alias("score"))

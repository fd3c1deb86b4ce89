"""Exact order statistics, ranks and running totals without a one-task sort.

``order_values`` narrows value ranges until the wanted ranks are isolated; ``rank_rows`` and
``running_totals`` range-partition once, stage the result, and add per-partition offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType
from pyspark.sql.window import Window as W

from casewise.session import stage

# A first sketch cuts a group at so many quantiles, each off by at most 1 / SKETCH of its rows; bounds leave five times that.
CUTS, SKETCH = 1000, 10_000
# The distinct values between two bounds are then cut into CELLS parts, ROUNDS times.
CELLS = 64
ROUNDS = 1
ROW_BITS = 33


def join_same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join on ``by`` where NULL keys match each other; without keys ``right`` is one row."""
    if not by:
        row = right.select(F.struct("*").alias("row")).scalar()
        return left.withColumn("_row", row).select(*left.columns, "_row.*")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in by})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by]
    condition = on[0]
    for clause in on[1:]:
        condition = condition & clause
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in by])


def order_values(df: DataFrame, value: str, wanted: Callable[[Column], dict[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """The values at given 1-based ranks, per group: columns ``by``, ``n`` and the wanted names, in the type of ``value``.

    A sketch gives two bounds around each rank. One pass then counts the rows below the bounds, exactly, and only values in between
    leave their task: well under a hundredth of a large group, whatever its share of the rows and wherever its values lie. The ranks among
    the values in between are exact, as all others are on a known side; they are found by cutting ranges of distinct values into cells, so
    not even what is in between is sorted in one task. NaN is the largest value.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    # Bounds are doubles, whatever the type: the cast keeps the order, and values that it makes equal are on the same side.
    place = (F.unix_date("_v") if isinstance(rows.schema["_v"].dataType, DateType) else F.col("_v")).cast("double")
    # The sketch is of the numbers alone; ranks beyond them are NaN, above the last cut.
    number = F.when(~F.isnan(place), place)
    cuts = F.percentile_approx(number, [i / CUTS for i in range(1, CUTS)], SKETCH).alias("_cuts")
    spans = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("_m"), cuts)
    targets = wanted(F.col("n"))
    names = list(targets)

    def cut(at: Column) -> Column:
        """The cut number ``at``; NULL beyond either end, which bounds nothing."""
        return F.when((at >= 1) & (at < CUTS), F.get("_cuts", at.cast("int") - 1))

    def low(at: Column) -> Column:
        return cut(F.least(at, F.lit(CUTS - 1)))

    bounds = []
    for k, rank in enumerate(targets.values()):
        share, margin = F.try_divide(rank.cast("double"), F.col("_m")), 5.0 / SKETCH
        bounds += [rank.cast("long").alias(f"_r{k}"), low(F.floor((share - margin) * CUTS)).alias(f"_lo{k}"), cut(F.ceil((share + margin) * CUTS)).alias(f"_hi{k}")]
    spans = stage(spans.select(*by, "n", *bounds), "bounds")

    ks = range(len(names))
    below = lambda k: F.coalesce(place < F.col(f"_lo{k}"), F.lit(False))
    above = lambda k: F.coalesce(place > F.col(f"_hi{k}"), F.lit(False))
    inside = reduce(lambda x, y: x | y, [~below(k) & ~above(k) for k in ks])
    marked = join_same(rows, spans, by).select(*by, F.when(inside, F.col("_v")).alias("_v"), *[(below(k) & ~inside).alias(f"_b{k}") for k in ks],
        F.when(inside, reduce(lambda x, y: x + y, [above(k).cast("int") for k in ks])).alias("_cell0"))  # upper bounds passed
    reduced = marked.groupBy(*by, "_v", "_cell0").agg(F.count(F.lit(1)).alias("_c"), *[F.count_if(f"_b{k}").alias(f"_b{k}") for k in ks])
    reduced = stage(reduced, "between")

    outside = reduced.where(F.col("_v").isNull()).select(*by, *[f"_b{k}" for k in ks])
    known = outside.select(*by, *[F.col(f"_b{k}").alias(f"_o{k}") for k in ks])
    between = reduced.where(F.col("_v").isNotNull()).select(*by, "_v", "_c", "_cell0")
    ranked = _with_outside(spans, known, by, ks)
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (F.col(f"_r{k}") - F.col(f"_o{k}")).alias("rank"), F.col(f"_lo{k}").alias("lo"), F.col(f"_hi{k}").alias("hi")) for k, name in enumerate(names)])
    asked = ranked.select(*by, "n", asked.alias("_asked"))
    upto = F.col("_upto")

    def hit(size):
        """The asked ranks that fall into the last ``size`` positions before ``_upto``."""
        return F.filter("_asked", lambda w: (w["rank"] <= upto) & (w["rank"] > upto - size))

    found = _narrow(between, asked, by, hit)
    beyond = F.coalesce((place < F.col("_w.lo")) | (place > F.col("_w.hi")), F.lit(False))
    value_of = F.when(beyond, F.raise_error(F.lit("a sketch was further off than it states"))).otherwise(F.col("_v"))
    picks = [F.max(F.when(F.col("_w.name") == name, value_of)).alias(name) for name in names]
    return found.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def _with_outside(spans: DataFrame, known: DataFrame, by: list[str], ks: Sequence[int]) -> DataFrame:
    """``spans`` with the rows known to be below each rank's bounds; none for a group whose rows all lie in between."""
    if by:
        renamed = known.withColumnsRenamed({c: f"_k_{c}" for c in by})
        on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
        joined = spans.join(renamed, on, "left")
    else:
        # One row or none: an aggregate always gives one.
        joined = join_same(spans, known.agg(*[F.max(f"_o{k}").alias(f"_o{k}") for k in ks]), by)
    return joined.withColumns({f"_o{k}": F.coalesce(f"_o{k}", F.lit(0)) for k in ks})


def _narrow(rows: DataFrame, asked: DataFrame, by: list[str], hit: Callable) -> DataFrame:
    """Find the asked ranks: count the values of each ``_cell0``, keep those cells that are hit, and cut them again at sketched quantiles, ``ROUNDS`` times."""
    cuts = F.percentile_approx("_v", [i / CELLS for i in range(1, CELLS)], 10 * CELLS).alias("_cuts")
    spans = asked.select(*by, "n", F.lit(0).cast("long").alias("_before"), "_asked")
    upto, path = F.col("_upto"), []
    for depth in range(1 + ROUNDS):
        here, name = by + path, f"_cell{depth}"
        if depth:
            cell = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
            rows = join_same(rows, spans.select(*here, "_cuts"), here).withColumn(name, cell).drop("_cuts")
        totals = rows.groupBy(*here, name).agg(F.sum("_c").alias("_size"), cuts)
        running = F.sum("_size").over(W.partitionBy(*here).orderBy(name))
        totals = join_same(totals, spans.select(*here, "n", "_before", "_asked"), here)
        totals = totals.withColumn("_upto", F.col("_before") + running)
        path = path + [name]
        spans = totals.select(
            *by, *path, "n", "_cuts", (upto - F.col("_size")).alias("_before"), hit(F.col("_size")).alias("_asked")
        ).where(F.size("_asked") > 0)
    here = by + path
    last = join_same(rows, spans.select(*here, "n", "_before", "_asked"), here)
    running = F.sum("_c").over(W.partitionBy(*here).orderBy("_v"))
    return last.withColumn("_upto", F.col("_before") + running).select(
        *by, "n", "_v", F.explode(hit(F.col("_c"))).alias("_w")
    )


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles (R type 7): columns ``by``, ``n`` and the names in ``probs``."""

    def spot(n, p):
        return (n - 1) * F.lit(float(p))

    def wanted(n):
        ranks = {}
        for name, p in probs.items():
            ranks[f"_a_{name}"] = F.floor(spot(n, p)) + 1
            ranks[f"_b_{name}"] = F.ceil(spot(n, p)) + 1
        return ranks

    picked = order_values(df, value, wanted, by)
    results = [
        (
            F.col(f"_a_{name}").cast("double")
            + (spot(F.col("n"), p) - F.floor(spot(F.col("n"), p))) * (F.col(f"_b_{name}") - F.col(f"_a_{name}")).cast("double")
        ).alias(name)
        for name, p in probs.items()
    ]
    return picked.select(*by, "n", *results)


def hinges(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Tukey hinges and median: columns ``by``, ``n``, ``lower``, ``median``, ``upper``."""

    def wanted(n):
        depth = F.floor((n + 3) / 2) / 2
        return {
            "l1": F.floor(depth), "l2": F.ceil(depth),
            "m1": F.floor((n + 1) / 2), "m2": F.ceil((n + 1) / 2),
            "u1": n + 1 - F.ceil(depth), "u2": n + 1 - F.floor(depth),
        }

    picked = order_values(df, value, wanted, by)
    middle = lambda a, b: (F.col(a).cast("double") + F.col(b).cast("double")) / 2
    return picked.select(
        *by, "n", middle("l1", "l2").alias("lower"), middle("m1", "m2").alias("median"), middle("u1", "u2").alias("upper")
    )


def _place(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """Sort across partitions and stage; ``_part``/``_row`` give each row its place."""
    slot = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumn("_slot", slot)
    placed = stage(placed, label)
    return placed.select(
        *df.columns, F.shiftright("_slot", ROW_BITS).alias("_part"), F.col("_slot").bitwiseAND(2**ROW_BITS - 1).alias("_row")
    )


def _offsets(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier partitions; one row per sort partition."""
    totals = placed.groupBy("_part").agg(*[e.alias(n) for n, e in sums.items()])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def rank_rows(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Exact 1-based global position under ``order`` (which must be a total order)."""
    placed = _place(df, order, "rank")
    offsets = _offsets(placed, {"_first": F.count(F.lit(1))})
    # One row per sort partition, so the broadcast is bounded by the partition count.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_first") + F.col("_row") + 1)
        .drop("_part", "_row", "_first")
    )


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Cumulative sums over a global order: ``sums`` maps new column -> summed column."""
    placed = _place(df, order, "running")
    offsets = _offsets(placed, {f"_o_{n}": F.sum(c) for n, c in sums.items()})
    so_far = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(so_far).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])

"""Merkle manifest: a hash tree over every group's rows, a tree over the groups' roots, and each row's proof.

Every ``FAN`` consecutive nodes of a level are a run and become their hash; the last run may be shorter. Windows do all of it. A block is
``FAN ** LEVELS`` consecutive rows of a tree, so a run never crosses it, and one exchange by (tree, block) serves every window of the block.
The nodes of level l stand in the rows whose place is a multiple of ``FAN ** l``, so brothers stand at the fixed offsets
``FAN ** l``, ``2 * FAN ** l``, ...: ``lag`` and ``lead`` columns, masked by the slot in the run and by the run's length, give each node its
brothers, and the rows of first children hash the parents. Proofs then go down the same offsets. The nodes that end a block are the
rows of the next round, ``FAN ** LEVELS`` times fewer, until each tree has one. No task holds more of a tree than its blocks.

Defined results. A null field is ``-`` in its hash, an empty one ``0:``. A null group comes before all others, a null key before the other
keys of its group. Rows of the same key stand in the order of their hashes; wholly equal rows are separate leaves. A null key is never tampered
with. A table without rows gives none. Other columns are not read, whatever their names. A value of any length is one field of one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewise.llm.common import write_table
from casewise.operators.order import rank_rows

FAN, LEVELS = 3, 5
NULL = "-"
_PROOF = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that neighbours can't run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(NULL))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: digest(level["before"], node, level["after"]))


def siblings(proof: Column) -> Column:
    """All hashes of a proof, from the leaf's level up, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def _div(value: Column, by: int) -> Column:
    return F.floor(value / by) if by > 1 else value


def _climb(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """``nodes`` with its block, the hash ``_d`` of the block, and for each level the brothers before and after: ``_b0``, ``_a0``, ..."""
    inside = W.partitionBy("tree", "block").orderBy("place")
    rows = nodes.withColumn("block", _div(F.col("place"), fan**levels)).withColumn("_d", F.col("digest"))
    for level in range(levels):
        step = fan**level
        node, size = _div(F.col("place"), step), F.ceil(F.col("size") / step)
        slot = node % fan
        length = F.least(F.lit(fan), size - (node - slot))
        here = F.col("place") % step == 0
        back = [F.when(slot >= k, F.lag("_d", k * step).over(inside)).otherwise("") for k in range(fan - 1, 0, -1)]
        ahead = [F.when(slot + k < length, F.lead("_d", k * step).over(inside)).otherwise("") for k in range(1, fan)]
        rows = rows.withColumns({f"_b{level}": F.when(here, F.concat(*back)), f"_a{level}": F.when(here, F.concat(*ahead))})
        parent = F.when(size > 1, digest(F.col("_d"), F.col(f"_a{level}"))).otherwise(F.col("_d"))
        rows = rows.withColumn("_d", F.when(F.col("place") % (step * fan) == 0, parent))
    return rows


def _descend(rows: DataFrame, fan: int, levels: int) -> DataFrame:
    """``rows`` of :func:`_climb` with the ``proof`` of their block: each node puts its brothers before its parent's proof."""
    inside = W.partitionBy("tree", "block").orderBy("place")
    for level in reversed(range(levels)):
        step = fan**level
        slot, size = _div(F.col("place"), step) % fan, F.ceil(F.col("size") / step)
        above = F.col("proof")
        for k in range(1, fan):
            above = F.when(slot == k, F.lag("proof", k * step).over(inside)).otherwise(above)
        own = F.array(F.struct(F.col(f"_b{level}").alias("before"), F.col(f"_a{level}").alias("after")))
        proof = F.when(size > 1, F.concat(own.cast(_PROOF), above)).otherwise(above)
        rows = rows.withColumn("proof", F.when(F.col("place") % step == 0, proof))
    return rows


def prove(nodes: DataFrame, largest: int, finish: Callable[[DataFrame], DataFrame], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Adds to the rows ``tree place size digest ...`` of trees of at most ``largest`` rows what ``finish`` says of their roots, and their ``proof``.

    ``place`` counts a tree's rows from 0, ``size`` is their number. ``finish`` gets one row per tree, with its root as ``digest``, and returns
    ``tree``, ``place``, ``proof`` (what stands above the root) and further columns.
    """
    if largest <= 1:
        return finish(nodes)
    span, climbed = fan**levels, _climb(nodes, fan, levels)
    tops = climbed.filter(F.col("place") % span == 0).select(
        "tree", F.col("block").alias("place"), F.ceil(F.col("size") / span).alias("size"), F.col("_d").alias("digest"))
    above = prove(write_table(tops), -(-largest // span), finish, fan, levels)
    above = above.select("tree", F.col("place").alias("block"), *[c for c in above.columns if c not in ("tree", "place", "size", "digest")])
    rows = _descend(climbed.join(above, ["tree", "block"]), fan, levels)
    return rows.select(*nodes.columns, *[c for c in above.columns if c not in ("tree", "block")])


def _placed(leaves: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``leaves`` with their ``place`` in their tree under ``order``, the tree's ``size``, and the largest size.

    All rows are ranked by one range sort. Its last key is the row's number in its input, so that equal rows don't share a task.
    """
    sort = [F.asc_nulls_first("tree"), *map(F.asc_nulls_first, order), F.asc("_number")]
    ranked = rank_rows(leaves.withColumn("_number", F.monotonically_increasing_id()), sort, "_rank").drop("_number")
    sizes = write_table(ranked.groupBy("tree").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("size")))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    return ranked.join(sizes, "tree").withColumn("place", F.col("_rank") - F.col("_first")).drop("_rank", "_first"), largest


def _forest(roots: DataFrame, fan: int, levels: int) -> DataFrame:
    """The tree over the trees' roots, ordered by the trees' names."""
    leaves = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    nodes, largest = _placed(leaves, ["name"])
    proved = prove(nodes, largest, lambda top: top.withColumns({"root": F.col("digest"), "proof": F.array().cast(_PROOF)}), fan, levels)
    return write_table(proved.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), "root", "proof"))


def manifest(rows: DataFrame, group: Column, key: Column, leaf: Column, keep: Sequence[Column] = (), fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """One row per row: ``key``, ``leaf``, its group's ``subroot``, the ``root``, its ``proof`` and the columns ``keep``.

    ``proof`` has, for each level from the leaf's to the root's, the concatenated hashes before and after the node in its run.
    """
    name = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(NULL))  # null sorts first: "-" is less than "="
    leaves = rows.select(name.alias("tree"), key.alias("key"), leaf.alias("digest"), *keep)
    kept = leaves.columns[3:]
    nodes, largest = _placed(leaves, ["key", "digest"])
    proved = prove(nodes, largest, lambda roots: _forest(roots, fan, levels), fan, levels)
    if largest <= 1:  # groups of single rows are their own roots
        proved = nodes.join(proved, ["tree", "place"])
    return proved.select("key", F.col("digest").alias("leaf"), "subroot", "root", "proof", *kept)


def audit(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof and roots, and whether the root still holds after newlines were deleted from texts.

    The texts of documents whose crc32 of the decimal id is even are tampered with. Columns of ``docs``: doc_id, source, lang, n_chars, text.
    """
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    original = digest(*map(field, columns.values()))
    altered = digest(*[field(F.translate(v, "\n", "") if c == "text" else v) for c, v in columns.items()])
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    proved = manifest(docs, F.col("source"), F.col("doc_id"), original, [F.when(touched, altered).alias("altered")])
    out = proved.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return out.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

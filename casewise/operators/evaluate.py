"""Splits and evaluation tables for any score column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from casewise.functions.hashing import SPAN, key_hash
from casewise.operators import order
from casewise.operators.aggregate import correlation
from casewise.operators.order import join_same
from casewise.operators.rank import bucket_ntile


def split_random(df: DataFrame, key: str, share: float = 0.7, seed: int = 100) -> DataFrame:
    """Mark training rows by the hash of their key: the same rows under any partitioning."""
    return df.withColumn("is_train", key_hash(seed, key) < int(share * SPAN))


def split_stratified(df: DataFrame, key: str, label: str, share: float = 0.7, seed: int = 100) -> DataFrame:
    """Mark the same share of every class: the rows with the smallest key hashes.

    The hash at the wanted rank is found per class by distributed order statistics, so a class of
    any size needs no sort in one task.
    """
    marked = df.withColumn("_h", key_hash(seed, key, digits=13))

    def wanted(n):
        return {"_cut": F.greatest(F.floor(n * share + 0.5), F.lit(1))}

    cuts = order.order_values(marked, "_h", wanted, [label])
    some = F.floor(F.col("n") * share + 0.5) > 0
    return join_same(marked, cuts, [label]).withColumn("is_train", some & (F.col("_h") <= F.col("_cut"))).drop("_h", "_cut", "n")


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("rows"))


def binary_metrics(df: DataFrame, label: str, score: str, cutoff: float) -> DataFrame:
    """Counts, accuracy, sensitivity and specificity at one cutoff; rows without a score are left out."""
    positive, called = F.col(label) == 1, F.col(score) >= cutoff
    counts = df.where(F.col(score).isNotNull()).agg(
        F.count_if(positive & called).alias("tp"), F.count_if(~positive & called).alias("fp"),
        F.count_if(positive & ~called).alias("fn"), F.count_if(~positive & ~called).alias("tn"),
    )
    return counts.select(
        "*",
        F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
        F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
    )


def class_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class: rows, hits, sensitivity, specificity and their mean (balanced accuracy)."""
    cells = confusion_matrix(df, actual, predicted)
    sides = F.array(
        F.struct(F.col(actual).alias("class"), F.col("rows").alias("rows"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("rows"), F.col("rows").alias("called")),
    )
    hit = F.when(F.col(actual) == F.col(predicted), F.col("rows")).otherwise(0)
    long = cells.select(F.posexplode(sides).alias("_side", "_s"), hit.alias("_hit"))
    per = long.groupBy("_s.class").agg(
        F.sum("_s.rows").alias("rows"), F.sum("_s.called").alias("called"),
        F.sum(F.when(F.col("_side") == 0, F.col("_hit")).otherwise(0)).alias("hits"),
    )
    total = cells.agg(F.sum("rows").alias("_n"))
    sens = F.try_divide(F.col("hits"), F.col("rows"))
    spec = F.try_divide(F.col("_n") - F.col("rows") - F.col("called") + F.col("hits"), F.col("_n") - F.col("rows"))
    return join_same(per, total, []).select(
        "class", "rows", "hits", sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy")
    )


def overall_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def cutoff_sweep(df: DataFrame, label: str, score: str, low: float = 0.01, high: float = 0.80, cuts: int = 100) -> DataFrame:
    """Sensitivity, specificity and accuracy at evenly spaced cutoffs.

    Every score is assigned once to the highest cutoff it reaches; the metrics are cumulative
    sums over the at most ``cuts + 1`` assigned values.
    """
    step = (high - low) / (cuts - 1)

    def cut(k: Column) -> Column:
        return F.lit(low) + k * F.lit(step)

    guess = F.floor((F.col(score) - low) / step)
    reached = F.when(cut(guess + 1) <= F.col(score), guess + 1).when(cut(guess) > F.col(score), guess - 1).otherwise(guess)
    slot = F.greatest(F.lit(-1), F.least(F.lit(cuts - 1), reached)).cast("long")
    counts = df.where(F.col(score).isNotNull()).groupBy(slot.alias("slot")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    grid = df.sparkSession.range(-1, cuts).withColumnRenamed("id", "slot")
    above = W.orderBy(F.col("slot").desc()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy()
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    p, n = F.sum("pos").over(whole), F.sum("neg").over(whole)
    swept = grid.join(counts, "slot", "left").fillna(0, ["pos", "neg"]).select(
        "slot", tp.alias("tp"), fp.alias("fp"), p.alias("p"), n.alias("n")
    )
    return swept.where(F.col("slot") >= 0).select(
        cut(F.col("slot")).alias("cutoff"),
        F.try_divide("tp", "p").alias("sensitivity"),
        F.try_divide(F.col("n") - F.col("fp"), F.col("n")).alias("specificity"),
        F.try_divide(F.col("tp") + F.col("n") - F.col("fp"), F.col("p") + F.col("n")).alias("accuracy"),
    )


def balanced_cutoff(sweep: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return sweep.where(F.abs(F.col("sensitivity") - F.col("specificity")) < tolerance)


def _score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative true and false positives per distinct score, from the highest down."""
    per_score = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return order.running_totals(per_score, [F.col("score").desc()], {"tp": "pos", "fp": "neg"})


def _totals(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.where(F.col(score).isNotNull()).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    curve = join_same(_score_curve(df, label, score), _totals(df, label, score), [])
    return curve.select("score", F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "n").alias("fpr"))


def ks_statistic(df: DataFrame, label: str, score: str) -> DataFrame:
    return roc_points(df, label, score).agg(F.max(F.col("tpr") - F.col("fpr")).alias("ks"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties counting half."""
    area = _score_curve(df, label, score).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)).alias("_area"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )
    return area.select(
        "positives", "negatives", F.try_divide(F.col("_area"), F.col("positives").cast("double") * F.col("negatives")).alias("auc")
    )


def gain_lift(df: DataFrame, key: str, label: str, score: str, groups: int = 10) -> DataFrame:
    """Per score bucket: rows, responders, cumulative responders, gain and lift."""
    cut = bucket_ntile(df.select(key, label, score), [F.col(score).desc(), F.col(key)], groups)
    table = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), F.sum(label).cast("long").alias("responders"))
    cumulative = F.sum("responders").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    every = F.sum("responders").over(W.partitionBy())
    gained = table.withColumn("cum_responders", cumulative).withColumn(
        "gain", F.try_divide(F.col("cum_responders") * 100.0, every)
    )
    return gained.withColumn("lift", F.col("gain") / (F.col("bucket") * (100.0 / groups)))


def holdout_r2(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Squared correlation; NULL if the outcome or the prediction is constant."""
    r = correlation(actual, predicted)
    return df.agg((r * r).alias("r2"))

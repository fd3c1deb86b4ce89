"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node becomes a rule, a conjunction of
comparisons of statistics with thresholds. A logistic regression with a lasso penalty weighs the rules and drops most of them; the
rest are compiled into one Spark column expression over the statistics.

Labels are learnt only from documents outside the held-out fifth, at most ``SAMPLE`` of them (those with the smallest hashed ids). That
sample of statistics is all that comes to the driver. Statistics read whole texts, and nothing but the text.

Null and empty texts have statistics of zero and get a score like any other; without labelled rows every score is 0.5. Repeated rows are
scored each.
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from casewise.llm.common import fresh, held_out

SAMPLE, CUTOFF = 10_000, 0.3
TREES, DEPTH, BINS, SHRINKAGE, LEAST_ROWS = 20, 3, 32, 0.3, 10
PENALTY, ROUNDS = 1e-3, 200
STATISTICS = [
    "log_bytes", "letters", "upper", "digits", "spaces", "lines", "stops", "bars", "marks", "others",
    "log_words", "word_bytes", "distinct_words", "log_distinct", "repeated_next", "distinct_lines", "line_words", "plain_words",
]


def _classes() -> np.ndarray:
    """Which of the byte statistics each byte counts for: (256, statistics from ``letters`` to ``others``)."""
    groups = [
        [*range(65, 91), *range(97, 123), *range(128, 256)], [*range(65, 91)], [*range(48, 58)], [32, 9, 13], [10],
        [ord(c) for c in ".,;:?"], [ord(c) for c in "|{}[]<>"], [ord(c) for c in "!#$%&*@^~=+_/\\"],
    ]
    out = np.zeros((256, 9))
    for i, group in enumerate(groups):
        out[group, i] = 1
    out[:, 8] = out[:, :8].sum(axis=1) == 0
    return out


_CLASSES = _classes()


def measure(texts) -> np.ndarray:
    """Statistics of each text: (texts, ``STATISTICS``)."""
    counts, words_of = np.zeros((len(texts), 256)), np.zeros((len(texts), 8))
    for i, text in enumerate(texts):
        if not text:
            continue
        counts[i] = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        n, distinct = len(words), len(set(words))
        words_of[i] = (
            np.log1p(n), counts[i].sum() / max(1, n), distinct / max(1, n), np.log1p(distinct), sum(map(operator.eq, words, words[1:])) / max(1, n),
            len(set(lines)) / len(lines), n / len(lines), sum(map(str.isalpha, words)) / max(1, n))
    total = counts.sum(axis=1, keepdims=True)
    return np.hstack([np.log1p(total), counts @ _CLASSES / np.maximum(total, 1), words_of])


STATISTICS_TYPE = StructType([StructField(s, DoubleType(), False) for s in STATISTICS])


def statistics(text: Column) -> Column:
    """The statistics as a struct column."""
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(measure(texts.tolist()), columns=STATISTICS)

    return F.pandas_udf(run, STATISTICS_TYPE)(F.coalesce(text, F.lit("")))


Rule = tuple[tuple[int, bool, float], ...]  # conditions (statistic, must it exceed the threshold, threshold)


def _grow(binned, cuts, gradient, curvature, rows, path: Rule, depth: int, rules: set, step: np.ndarray) -> None:
    """Splits ``rows`` by the best gain, collects the paths, and writes the leaves' values into ``step``."""
    if path:
        rules.add(tuple(sorted(path)))
    g, c = gradient[rows], curvature[rows]
    best = (1e-6, None)
    if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        whole = g.sum() ** 2 / (c.sum() + 1)
        for f in range(binned.shape[1]):
            b, n = binned[rows, f], len(cuts[f]) + 1
            left_g, left_c, left_n = (np.cumsum(np.bincount(b, v, n))[:-1] for v in (g, c, np.ones(len(rows))))
            gain = left_g**2 / (left_c + 1) + (g.sum() - left_g) ** 2 / (c.sum() - left_c + 1) - whole
            gain[(left_n < LEAST_ROWS) | (len(rows) - left_n < LEAST_ROWS)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        step[rows] = -g.sum() / (c.sum() + 1)
        return
    f, at = best[1]
    above = binned[rows, f] > at
    for side, chosen in ((True, rows[above]), (False, rows[~above])):
        _grow(binned, cuts, gradient, curvature, chosen, (*path, (f, side, float(cuts[f][at]))), depth + 1, rules, step)


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """All paths of boosted trees for a logistic loss. A threshold is a value of the sample; a rule asks for more than it, or not."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    margin, rules = np.zeros(len(y)), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), (), 0, rules, step)
        margin += SHRINKAGE * step
    return sorted(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, threshold in rule:
        out &= (x[:, f] > threshold) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty on all weights but the intercept, by accelerated proximal gradient steps."""
    n = len(y)
    design = np.hstack([np.ones((n, 1)), z])
    probe = np.ones(design.shape[1])
    for _ in range(20):  # largest curvature
        probe = design.T @ (design @ probe)
        probe /= np.linalg.norm(probe)
    rate = 4 * n / float(np.linalg.norm(design @ probe) ** 2)
    w = ahead = np.zeros(design.shape[1])
    pace = 1.0
    for _ in range(rounds):
        gradient = design.T @ (1 / (1 + np.exp(-(design @ ahead))) - y) / n
        new = ahead - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / next_pace * (new - w), new, next_pace
    return float(w[0]), w[1:]


class Model:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[float, Rule]]):
        self.intercept, self.rules = intercept, rules

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * holds(rule, x) for w, rule in self.rules), np.zeros(len(x)))

    def column(self, stats: Column) -> Column:
        """The score as an expression over the struct of statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            test = F.lit(True)
            for f, above, threshold in rule:
                value = stats[STATISTICS[f]]
                test = test & ((value > threshold) if above else (value <= threshold))
            total = total + F.when(test, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    if len(y) == 0:
        return Model(0.0, [])
    rules = grow_rules(x, y)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso(z, y)
    return Model(intercept, [(float(w), r) for w, r in zip(weights, rules) if w != 0])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows; a label is 0 or 1, others and nulls are left out."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("key")))
    chosen = known.orderBy(F.xxhash64(F.col("key").cast("string")), "key", "label").limit(sample)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(chosen), "key")  # at most ``sample`` short rows
    got = rows.select("key", "label", statistics(F.col("text")).alias("s")).orderBy(F.xxhash64(F.col("key").cast("string")), "key", "label", "s").limit(sample)
    table = got.select("label", "s.*").toPandas()
    return learn(table[STATISTICS].to_numpy(float), table["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a new column of scores, and its name."""
    stats, name = fresh(docs, "_statistics"), fresh(docs, "score")
    return docs.withColumn(stats, statistics(F.col(text))).withColumn(name, model.column(F.col(stats))).drop(stats), name


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without those scored below ``CUTOFF``."""
    scored, name = score(docs, fit(docs, labels, text, key), text)
    return scored.filter(F.col(name) >= CUTOFF).select(*docs.columns)

"""Kernel features from landmarks against the exact kernel and the random features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.operators import evaluate as ev
from casewise.operators import landmarks, reduce


def exact(x, gamma):
    return np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))


def frame(spark, x, parts=3):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k long, v array<double>").repartition(parts)


def mapped(df, name="_features"):
    return np.array([r[name].toArray() for r in df.orderBy("k").collect()])


@pytest.mark.parametrize("seed,dims,gamma", [(1, 2, 0.5), (2, 8, 0.125), (3, 30, 1 / 30)])
def test_error_below_random_features(spark, seed, dims, gamma):
    """Clusters, a third of all rows one vector: at equal width nearer to the kernel than random features, and never above it."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6, dims))[rng.integers(0, 6, 240)] * 1.5 + rng.normal(scale=0.4, size=(240, dims))
    x[:80] = x[0]
    df, kernel = frame(spark, x), exact(x, gamma)
    found = landmarks.choose(df, "k", "v", 40, gamma)
    ours = mapped(landmarks.features(df, "v", found))
    width = ours.shape[1]
    random = mapped(reduce.fourier_features(df, "v", dims, width, gamma))
    error = np.linalg.norm(kernel - ours @ ours.T)
    assert width <= 40 and error < 0.5 * np.linalg.norm(kernel - random @ random.T)
    assert len(np.unique(found.points, axis=0)) == width  # copies are taken once
    assert np.linalg.eigvalsh(kernel - ours @ ours.T).min() > -1e-7
    assert np.allclose(found.root @ found.root.T, exact(found.points, gamma), atol=1e-9)


def test_same_landmarks_on_any_partitions(spark):
    x = np.random.default_rng(5).normal(size=(150, 4))
    a, b = (landmarks.choose(frame(spark, x, n), "k", "v", 30, 0.2, block=8) for n in (1, 16))
    assert np.allclose(a.points, b.points) and len(a.points) == 30


def test_low_rank_null_and_empty(spark):
    """Three different vectors give three landmarks and the exact kernel; NULL and NaN vectors take no part; an empty table has none."""
    three = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    x = three[np.arange(60) % 3]
    df = frame(spark, x).unionByName(spark.createDataFrame([(90, None), (91, [1.0, float("nan")])], "k long, v array<double>"))
    found = landmarks.choose(df, "k", "v", 20, 0.7)
    assert len(found.points) == 3
    out = landmarks.features(df, "v", found)
    got = mapped(out.where("k < 60"))
    assert np.allclose(got @ got.T, exact(x, 0.7)) and out.where("k = 90").first()["_features"] is None
    assert landmarks.choose(df.where("k < 0"), "k", "v", 5, 1.0) is None
    assert landmarks.choose(df.where("k = 90"), "k", "v", 5, 1.0) is None


def test_classifier_on_a_ring(spark):
    x = np.random.default_rng(8).normal(size=(400, 2))
    df = frame(spark, x).withColumn("y", F.expr("CAST(v[0] * v[0] + v[1] * v[1] > 1.4 AS INT)"))
    rows = landmarks.features(df, "v", landmarks.choose(df, "k", "v", 40, 0.5))
    for head in ("logistic", "svc"):
        called = reduce.kernel_classifier(rows, "y", 400, cost=2.0, head=head).transform(rows).withColumn("p", F.col("prediction").cast("int"))
        assert ev.overall_accuracy(called, "y", "p").first()["accuracy"] > 0.93

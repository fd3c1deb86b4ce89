"""Leading components against the dense decomposition."""

import numpy as np
import pytest

from casewise.operators import subspace


def vectors(n, width, seed=2):
    rng = np.random.default_rng(seed)
    scale = 50 * 0.7 ** np.arange(width) + 0.01
    basis, _ = np.linalg.qr(rng.normal(size=(width, width)))
    return rng.normal(size=(n, width)) * scale @ basis.T + rng.normal(size=width) * 100


def frame(spark, x, parts):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id long, v array<double>").repartition(parts)


def dense(x, k):
    values, basis = np.linalg.eigh(np.cov(x, rowvar=False))
    basis = basis[:, ::-1][:, :k]
    return values[::-1], basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)


@pytest.mark.parametrize("n,width,parts", [(400, 40, 1), (400, 40, 9), (150, 700, 4)])
def test_equal_to_the_dense_components(spark, n, width, parts):
    x = vectors(n, width)
    given = frame(spark, x, parts)
    found = subspace.leading_components(given, "v", 6)
    values, basis = dense(x, 6)
    assert found.n == n and found.variance == pytest.approx(values[:6], rel=1e-8)
    np.testing.assert_allclose(found.vectors, basis, atol=1e-6)
    assert found.share == pytest.approx(values[:6] / values.sum(), rel=1e-8)
    rows = {r["id"]: r["projected"] for r in subspace.project(given, "v", found).collect()}
    assert rows[-1] is None
    np.testing.assert_allclose([rows[i] for i in range(n)], (x - x.mean(axis=0)) @ basis, atol=1e-4)


def test_no_square_matrix_and_few_rows(spark):
    """A task returns width x block numbers at most; two rows have one component; none have none."""
    x = vectors(30, 50)
    product = subspace._multiplied(subspace._rows(frame(spark, x, 3), "v"), x.mean(axis=0), np.eye(50)[:, :4])
    np.testing.assert_allclose(product, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))[:, :4], rtol=1e-9)
    two = subspace.leading_components(frame(spark, x[:2], 2), "v", 3)
    assert len(two.variance) == 1 and two.share[0] == pytest.approx(1)
    assert subspace.leading_components(frame(spark, x[:0], 1), "v", 3) is None
    flat = subspace.leading_components(frame(spark, np.ones((5, 3)), 2), "v", 2)
    assert flat.variance == pytest.approx([0, 0]) and np.isnan(flat.share).all()

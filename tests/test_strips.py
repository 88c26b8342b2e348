import tracemalloc

import numpy as np
import pytest

from pointloom.functions.kernels import get_kernel
from pointloom.functions.polynomials import monomials
from pointloom.operators import compact, factors


@pytest.mark.parametrize("diff", [(1, 0), None])
@pytest.mark.parametrize("numbers", [100_000, 0])
def test_fits_of_more_pairs_than_are_gathered(spark, monkeypatch, diff, numbers):
    """By strips without a pair formed, and where the factor would be too large by conjugate gradients."""
    monkeypatch.setattr(compact, "STRIP_NUMBERS", numbers)
    if numbers:
        monkeypatch.setattr(compact, "sparse_pairs", None)
    rng = np.random.default_rng(7)
    n = 90 if numbers else 16
    y = np.concatenate([rng.random((n - 5, 2)), rng.random((5, 2)) + [3, 0]])  # empty strips between
    d = np.sin(4 * y[:, 0]) + y[:, 1]
    k, p = get_kernel("wen31").array(y, y, 0.4) + 0.25 * np.eye(n), monomials(y, 0)
    c = np.linalg.solve(np.block([[k, p], [p.T, np.zeros((1, 1))]]), np.append(d, 0))
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(y, d, strict=True))], "id long, x0 double, x1 double, d double")
    got = {r.id: r.d for r in compact.CompactInterpolant(df, phi="spwen31", eps=0.4, order=0, sigma=0.5, most=10)(df, diff).collect()}
    want = get_kernel("wen31").array(y, y, 0.4, diff or (0, 0)) @ c[:n] + monomials(y, 0, diff or (0, 0)) @ c[n:]
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-6)


def test_factors_are_not_factored_again(monkeypatch):
    """Triangles are solved by products: a general solver sees small ones only."""
    rng, sizes, solve = np.random.default_rng(3), [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: sizes.append(len(a)) or solve(a, b))
    y = rng.random((700, 2))
    kernel, p, d = get_kernel("wen30"), monomials(y, 1), rng.random((700, 2))
    a, b = factors.SparsePartitionedSolver(factors.Strips(y, 0.0, kernel, 0.4), p).solve(d)
    assert max(sizes) <= 128
    want = solve(np.block([[kernel.array(y, y, 0.4), p], [p.T, np.zeros((3, 3))]]), np.concatenate([d, np.zeros((3, 2))]))
    assert np.allclose(a, want[:700], atol=1e-7) and np.allclose(b, want[700:], atol=1e-7)


def test_kernel_arrays_take_one_axis_at_a_time():
    x = np.random.default_rng(4).random((300, 32))
    tracemalloc.start()
    got = get_kernel("ga").array(x, x, 0.5, (1, *[0] * 31))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gap = x[:, None] - x[None]
    assert most < 16 * got.nbytes  # the differences along all axes are 32 times the values
    assert np.allclose(got, -0.5 * gap[..., 0] * np.exp(-0.25 * (gap**2).sum(-1)))

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import bsplines, kernels, polynomials

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("name", kernels.KERNELS)
def test_derivatives_match_differences(name):
    k, eps, h = kernels.get_kernel(name), 3.0 if kernels.get_kernel(name).divides else 0.7, 1e-5
    c = np.array([[0.5, 2.1]])
    for x in (np.array([[1.2, 3.3]]), np.array([[0.7, 1.4]])):
        for diff in ((1, 0), (0, 1), (2, 0), (1, 1)):
            i = next(i for i, a in enumerate(diff) if a)
            lower, step = tuple(a - (j == i) for j, a in enumerate(diff)), h * np.eye(2)[i]
            want = (k.array(x + step, c, eps, lower) - k.array(x - step, c, eps, lower)) / (2 * h)
            assert np.allclose(k.array(x, c, eps, diff), want, rtol=1e-4, atol=1e-6), diff


@pytest.mark.parametrize("name", [n for n, k in kernels.KERNELS.items() if k.tol])
def test_limits_join_smoothly(name):
    k = kernels.get_kernel(name)
    for diff in ((0, 0), (1, 0)):
        x = np.array([[1.1 * k.tol, 0.0]])
        assert abs(k.array(x, np.zeros((1, 2)), 1.0, diff)[0, 0] - k.center_value(diff)) < 1e-3
    assert k.array(np.zeros((1, 2)), np.zeros((1, 2)))[0, 0] == k.center_value((0, 0))


def test_center_values():
    at = lambda n, d, e=1.0: kernels.get_kernel(n).center_value(d, e)
    assert at("phs1", (1, 0), 2.0) == -2.0 and at("phs1", (0, 1)) == 0.0
    assert at("phs3", (2, 0)) == 0.0 and at("phs2", (2, 0)) == -math.inf
    assert math.isclose(at("mat52", (2,), 2.0), -5 / 12) and at("ga", (2,)) == -2.0 and math.isnan(at("exp", (1,)))


@pytest.mark.parametrize("name", kernels.KERNELS)
def test_conditionally_positive_definite(name):
    k = kernels.get_kernel(name)
    x = RNG.random((40, 3))
    p = polynomials.monomials(x, k.cpd_order - 1)
    matrix = k.array(x, x, 1.0)
    for _ in range(20):
        c = RNG.standard_normal(40)
        c -= p @ np.linalg.lstsq(p, c, rcond=None)[0]
        if not name.endswith("wen10"):
            assert c @ matrix @ c >= -1e-8


@pytest.mark.parametrize("name", ["phs2", "phs5", "mq", "imq", "ga", "exp", "mat32", "wen31", "spwen12"])
def test_columns_equal_arrays(spark, name):
    k = kernels.get_kernel(name)
    x = RNG.random((30, 3)).tolist() + [[0.5, 0.5, 0.5]]
    df = spark.createDataFrame([tuple(r) for r in x], "a double, b double, c double")
    for diff in ((0, 0, 0), (1, 0, 0), (1, 0, 1)):
        got = df.select(k.column([F.col(n) - 0.5 for n in "abc"], 0.9, diff).alias("v")).toPandas()["v"].to_numpy(float)
        want = k.array(np.array(x), np.full((1, 3), 0.5), 0.9, diff)[:, 0]
        ok = np.isfinite(want)
        assert np.allclose(got[ok], want[ok])


def test_registry_and_custom_kernel():
    assert len(kernels.KERNELS) == 28
    with pytest.raises(ValueError):
        kernels.get_kernel("none")
    own = kernels.CustomKernel([lambda r, e: (1 + (e * r) ** 2) ** -0.5])
    x, c = RNG.random((5, 2)), RNG.random((3, 2))
    assert np.allclose(own.array(x, c, 1.3), kernels.get_kernel("imq").array(x, c, 1.3))
    assert np.allclose(own.array(x, c, 1.3, (1, 0)), kernels.get_kernel("imq").array(x, c, 1.3, (1, 0)), atol=1e-3)


def test_polynomials():
    assert polynomials.monomial_powers(2, 2) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
    assert polynomials.monomial_powers(-1, 3) == [] and polynomials.monomial_count(3, 2) == 10
    assert [polynomials.max_degree(n, 2) for n in (0, 1, 2, 3, 6)] == [-1, 0, 0, 1, 2]
    assert polynomials.monomials([[2.0, 3.0]], 2, (1, 1)).tolist() == [[0, 0, 0, 0, 1, 0]]


def test_bsplines_sum_to_one_and_differentiate(spark):
    knots = bsplines.augmented_knots(0, 1, 3, 3)
    n = bsplines.basis_number(knots, 3)
    x = np.linspace(0, 0.99, 23)
    assert np.allclose(sum(bsplines.bspline_array(x, knots, i, 3) for i in range(n)), 1)
    for i, h in itertools.product(range(n), [1e-6]):
        want = (bsplines.bspline_array(x + h, knots, i, 3) - bsplines.bspline_array(x, knots, i, 3)) / h
        assert np.allclose(bsplines.bspline_array(x, knots, i, 3, 1), want, atol=1e-3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert np.allclose(df.select(bsplines.bspline(F.col("x"), knots, 2, 3).alias("v")).toPandas()["v"], bsplines.bspline_array(x, knots, 2, 3))

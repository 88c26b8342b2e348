import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import checks
from pointloom.functions.expressions import ExpressionKernel
from pointloom.functions.kernels import KERNELS
from pointloom.operators import factors, gp, linalg, pairs


def banded(n, density, seed):
    rng = np.random.default_rng(seed)
    m = (rng.random((n, n)) < density) * rng.standard_normal((n, n))
    m = m + m.T
    return m + np.eye(n) * (np.abs(m).sum(1).max() + 1)


def taken(m):
    r, c = np.nonzero(m)
    return factors.Entries(r, c, m[r, c], len(m))


@pytest.mark.parametrize("n, density", [(1, 0.5), (40, 0.05), (80, 0.03), (60, 0.0), (30, 1.0)])
def test_factors_match_dense_ones(n, density):
    m, rng = banded(n, density, n), np.random.default_rng(1)
    b = rng.standard_normal((n, 3))
    s = factors.positive_solver(taken(m))
    assert isinstance(s, factors.SparsePosDefSolver) and isinstance(factors.positive_solver(m), linalg.PosDefSolver)
    assert np.allclose(s.solve(b), np.linalg.solve(m, b)) and math.isclose(s.log_det(), np.linalg.slogdet(m)[1])
    low = s.L().dense()
    assert np.allclose(low @ low.T, m) and np.allclose(low @ s.solve_L(b), b)
    g = m + np.triu(rng.random((n, n)) * (m != 0), 1)
    assert np.allclose(factors.solver(taken(g)).solve(b[:, 0]), np.linalg.solve(g, b[:, 0]))
    p = rng.standard_normal((n, min(n, 2)))
    x, y = factors.SparsePartitionedSolver(taken(m), p).solve(b)
    u, v = linalg.PartitionedPosDefSolver(m, p).solve(b)
    assert np.allclose(x, u) and np.allclose(y, v)


def test_what_factors_refuse():
    with pytest.raises(np.linalg.LinAlgError):
        factors.SparsePosDefSolver(taken(np.diag([1.0, -1.0])))
    with pytest.raises(np.linalg.LinAlgError):
        factors.SparseSolver(factors.Entries([0, 1], [0, 0], [1, 1], 2)).solve(np.ones(2))
    for bad in ((np.ones((2, 3)),), (np.array([[math.nan]]),)):
        with pytest.raises(ValueError):
            factors.as_matrix(*bad)
    with pytest.raises(ValueError):
        factors.Entries([3], [0], [1.0], 2)


def test_order_narrows_the_band():
    rng = np.random.default_rng(2)
    name = rng.permutation(400)
    at = np.arange(400).reshape(20, 20)
    u = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()])
    v = np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    order = factors.cuthill_mckee(name[u], name[v], 400)
    assert sorted(order.tolist()) == list(range(400)) and factors.bandwidth(name[u], name[v], order) <= 25
    assert factors.cuthill_mckee([], [], 3).tolist() == [2, 1, 0] and len(factors.cuthill_mckee([], [], 0)) == 0


def test_gmres_matches_dense(spark):
    m = banded(5, 0.4, 5) + np.triu(np.ones((5, 5)), 1) / 2
    r, c = np.nonzero(m)
    a = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(r, c, strict=True)], "row long, col long, value double")
    want = np.linalg.solve(m, np.arange(1.0, 6))
    b = spark.createDataFrame([(k, k + 1.0) for k in range(5)], "row long, value double")
    got = {x.row: x.x for x in linalg.gmres(a, b, restart=4).collect()}
    assert all(abs(got[k] - want[k]) < 1e-5 for k in range(5))


@pytest.mark.parametrize("text, name", [("exp(-r**2)", "ga"), ("-sqrt(1 + (eps*r)**2)", "mq"), ("1/(1 + r*r)", "iq"), ("(eps*r)**3", "phs3")])
def test_expressions_have_exact_derivatives(text, name):
    rng = np.random.default_rng(0)
    x, c, k = rng.random((5, 2)), rng.random((4, 2)), pickle.loads(pickle.dumps(ExpressionKernel(text)))
    for diff in ((0, 0), (1, 0), (1, 1), (2, 1), (2, 2)):
        assert np.allclose(k.array(x, c, 1.7, diff), KERNELS[name].array(x, c, 1.7, diff)), diff


def test_expression_columns_and_limits(spark):
    k = ExpressionKernel("tanh(r) * exp(-eps*r) + cos(r)", tol=1e-6, limits={(0, 0): "1", (1, 0): "1 + 0*eps"}, supp=1.5)
    rows = [(0, 0.0, 0.0), (1, 0.4, -0.3), (2, 2.0, 2.0)]
    points = spark.createDataFrame(rows, "id long, x0 double, x1 double")
    center = spark.createDataFrame([(0, 0.0, 0.0)], "id long, x0 double, x1 double")
    for diff in ((0, 0), (1, 0), (1, 1)):
        want = k.array(np.array([r[1:] for r in rows]), np.zeros((1, 2)), 0.8, diff)[:, 0]
        got = {r.i: r.value for r in pairs.all_pairs(points, center, k, 0.8, diff).collect()}
        assert np.allclose([got[i] for i in range(3)], want, atol=1e-9), diff
    assert k.array(np.zeros((1, 2)), np.zeros((1, 2)), 0.8, (1, 0))[0, 0] == 1


@pytest.mark.parametrize("text", ["q + r", "eps", "r +", "open(r)", "r.real", "exp(r, r)", "[r]"])
def test_expressions_that_are_refused(text):
    with pytest.raises(ValueError):
        ExpressionKernel(text)


def test_checks():
    assert checks.assert_shape([[1, 2]], (None, 2)).shape == (1, 2) and checks.assert_shape(np.zeros((3, 4, 2)), (..., 2)).ndim == 3
    for shape in ((2,), (3, 2), (..., 3)):
        with pytest.raises(ValueError):
            checks.assert_shape([[1, 2]], shape)
    with checks.no_shape_assertions():
        checks.assert_shape([1], (2,))
    assert checks.arg_count(lambda a, b, *, c=1: 0) == 2 and checks.arg_count(lambda *a: 0) > 100
    calls = []
    f = checks.Memoize(lambda a, b: calls.append(1) or a.sum() + b, most=2)
    x = np.arange(3)
    assert f(x, 1) == f(x.copy(), 1) == 4 and len(calls) == 1
    assert f(x.astype(float), 1) == 4 and f(x, 2) == 5 and f(x, 1) == 4 and len(calls) == 4
    checks.clear_memories()
    assert f(x, 1) == 4 and len(calls) == 5


def test_process_components():
    p = gp.GaussianProcess(mean=lambda x: x[:, 0], covariance=lambda a, b: np.exp(-((a[:, None, 0] - b[None, :, 0]) ** 2)), dim=1)
    q, x = (p + gp.gppoly(0)).memoize(), np.array([[0.0], [2.0]])
    assert q.mean(x).tolist() == [0, 2] and math.isclose(q.covariance(x, x)[0, 1], math.exp(-4))
    with pytest.raises(ValueError):
        p.differentiate((1,)).mean(x)
    with pytest.raises(ValueError):
        gp.GaussianProcess(mean=lambda x: x).mean(x)
    assert np.allclose(q.condition(x, [1.0, 5.0]).mean(x), [1, 5])


def test_lanes_of_hot_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([rng.random((120, 2)) * 0.1, rng.random((40, 2)) * 3]))]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double").withColumn("w", F.col("id") * 2)
    got = sorted((r.i, r.j, r.w) for r in pairs.radius_join(df, df, 0.15, keep=["w"], hot=7).collect())
    assert got == sorted((p[0], q[0], 2 * q[0]) for p in rows for q in rows if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 0.15**2)

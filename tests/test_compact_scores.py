import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import factors, interpolate
from pointloom.plans import queries


@pytest.fixture
def sites(spark):
    rng = np.random.default_rng(5)
    y = rng.random((70, 2))
    d = np.sin(4 * y[:, 0]) + y[:, 1]
    return y, d, spark.createDataFrame([(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(y, d, strict=True))], "id long, x0 double, x1 double, d double")


@pytest.fixture
def equal_balances(spark, tmp_path):
    """60 suppliers, of which each balance belongs to two."""
    t = spark.range(60).select(F.col("id").alias("s_suppkey"), (F.col("id") % 30 * 17 - 200.0).alias("s_acctbal"))
    t.write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path), np.sin(np.array([r.s_acctbal for r in t.orderBy("s_suppkey").collect()]) / 1000)


def test_inverse_diagonal(monkeypatch):
    monkeypatch.setattr(factors, "BLOCK", 1)
    rng = np.random.default_rng(2)
    a = np.diag(rng.random(40) + 4) + np.diag(np.full(38, -1.0), 2) + np.diag(np.full(38, -1.0), -2)
    solver = factors.SparsePosDefSolver(factors.Entries(*np.nonzero(a), a[np.nonzero(a)], 40))
    assert len(solver.factor) > 3 and np.allclose(solver.inverse_diagonal(), np.diag(np.linalg.inv(a)))


def test_folds_of_more_sites_than_a_dense_system_takes(spark, sites, equal_balances, monkeypatch):
    how = {"phi": "wen12", "eps": 0.3, "order": 1, "sigma": 0.1}
    y, d, df = sites
    want = {}
    for f in range(4):
        held = np.arange(70) % 4 == f
        fit = interpolate.solve_systems(y[~held], d[~held, None], np.full((~held).sum(), 0.1), interpolate._kernel("wen12"), 0.3, 1)
        want[f] = np.sqrt(((interpolate.evaluate(y[held], y[~held], *fit, interpolate._kernel("wen12"), 0.3, 1, None)[:, 0] - d[held]) ** 2).mean())
    monkeypatch.setattr(interpolate, "MOST_SITES", 30)
    got = {r.fold: r.rmse for r in interpolate.cross_validate(df, 4, **how).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], rel_tol=1e-8) for f in want)
    tables, v = equal_balances
    fold = np.arange(60) % 5
    means = {f: round(float(np.sqrt(((v[fold == f] - v[fold != f].mean()) ** 2).mean())), 6) for f in range(5)}
    assert {r.fold: r.rmse for r in queries.QUERIES["cross_validate_means"](spark, tables).collect()} == pytest.approx(means, abs=1.1e-6)


@pytest.mark.parametrize("method", ["gml", "loocv"])
def test_scores_of_more_sites_than_a_dense_system_takes(spark, sites, equal_balances, monkeypatch, method):
    y, d, df = sites
    grid = spark.createDataFrame([(s, e) for s in (0.0, 0.2) for e in (0.05, 0.4)], "sigma double, eps double")
    one = getattr(interpolate, method)
    want = {(r.sigma, r.eps): one(y, d, r.sigma, "wen11", r.eps, 1) for r in grid.collect()}
    monkeypatch.setattr(interpolate, "MOST_SITES", 30)
    got = {(r.sigma, r.eps): r.score for r in interpolate.parameter_scores(df, grid, phi="wen11", order=1, method=method).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-7) for k in want)
    tables, v = equal_balances
    off = v - v.mean()
    score = float((off**2).sum()) if method == "gml" else float(np.sqrt(((off * 60 / 59) ** 2).sum()))
    assert [r.score for r in queries.QUERIES[f"{method}_grid"](spark, tables).collect()] == pytest.approx([score] * 40, abs=1.1e-6)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.formulation import Operator
from pointloom.functions.kernels import get_kernel
from pointloom.functions.polynomials import monomials
from pointloom.operators import fields, interpolate, nodes
from pointloom.operators.compact import CompactInterpolant
from pointloom.sources import points as P


def scattered(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.random((n, 2))
    df = spark.createDataFrame([(int(i), *map(float, p), float(math.sin(4 * p[0]) + p[1])) for i, p in enumerate(y)], "id long, x0 double, x1 double, d double")
    return y, df.toPandas()["d"].to_numpy(), df


@pytest.mark.parametrize("most", [10_000, 10])
def test_compact_fit_matches_the_dense_system(spark, most):
    n = 60 if most > 100 else 16
    y, d, df = scattered(spark, n)
    order, eps, sigma = (1, 0.5, 0.1) if most > 100 else (0, 0.4, 0.5)
    k, p = get_kernel("wen32").array(y, y, eps) + sigma**2 * np.eye(n), monomials(y, order)
    c = np.linalg.solve(np.block([[k, p], [p.T, np.zeros((p.shape[1],) * 2)]]), np.concatenate([d, np.zeros(p.shape[1])]))
    at, _, where = scattered(spark, 9, 3)
    fit = CompactInterpolant(df, phi="spwen32", eps=eps, order=order, sigma=sigma, most=most, tolerance=1e-9)
    for diff in ((0, 0), (1, 0)):
        want = get_kernel("wen32").array(at, y, eps, diff) @ c[:n] + monomials(at, order, diff) @ c[n:]
        got = {r.id: r.d for r in fit(where, diff).collect()}
        assert np.allclose([got[i] for i in range(9)], want, atol=1e-5)


def test_compact_kernels_only(spark):
    with pytest.raises(ValueError):
        CompactInterpolant(scattered(spark, 5)[2], phi="ga")
    with pytest.raises(NotImplementedError):
        interpolate.loocv(np.random.rand(5, 2), np.zeros(5), phi="spwen32")


def test_low_pass_matches_the_dense_system(spark):
    rng = np.random.default_rng(1)
    d = np.sin(np.arange(40) / 6) + rng.standard_normal(40) / 5
    s = 0.2 + rng.random(40)
    rows = [(i, float(i), None if i == 7 else float(d[i]), None if i == 20 else float(s[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x0 double, d double, s double")
    lap = np.diag(np.full(40, -2.0)) + np.eye(40, k=1) + np.eye(40, k=-1)
    lap[0, :3], lap[-1, -3:] = [1, -2, 1], [1, -2, 1]
    w = np.where(np.isin(np.arange(40), (7, 20)), 0, s**-2)
    a = np.diag(w) + lap.T @ lap / ((2 * np.pi * 0.05) ** 2 / np.sqrt(w[w > 0].mean())) ** 2
    inverse = np.linalg.inv(a)
    got = fields.low_pass(df, 0.05, n=3, sigma="s").orderBy("id").toPandas()
    assert np.allclose(got["mean"], inverse @ (w * d), atol=1e-6)
    assert np.allclose(got["sd"], np.sqrt(np.diag(inverse @ np.diag(w) @ inverse)), atol=1e-6)
    drawn = fields.low_pass(df, 0.05, n=3, sigma="s", samples=4000, fill="none").orderBy("id").toPandas()
    assert drawn["mean"].isna().sum() == 2 and np.allclose(drawn["sd"].dropna(), got["sd"].drop([7, 20]), rtol=0.1)


def test_low_pass_over_frames(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(10)], "id long, x0 double, d double")
    near = fields.low_pass(df, 0.2, n=3).orderBy("id").toPandas()
    far = fields.low_pass(df, 0.2, n=3, most=3, samples=2).orderBy("id").toPandas()
    assert np.allclose(near["mean"], far["mean"], atol=1e-5) and (far["sd"] >= 0).all()
    with pytest.raises(ValueError):
        fields.low_pass(df.withColumn("d", F.lit(None).cast("double")), 0.1, n=3)


def test_recursive_integral_in_a_domain(spark):
    got = fields.recursive_monte_carlo(spark, lambda x: F.lit(2.0), [-1, -1], [1, 1], samples=200, tolerance=0.1, depth=6, domain=nodes.as_domain(spark, P.circle(4))).first()
    assert abs(got.integral - 2 * math.pi) < 0.1 and got.boxes > 4 and got.error < 0.3


def test_steps_follow_a_rotation(spark):
    state = spark.createDataFrame([(0, 1.0), (1, 0.0)], "row long, x double")
    turned = fields.rk4(lambda u: u.select((1 - F.col("row")).alias("row"), F.when(F.col("row") == 0, F.col("x")).otherwise(-F.col("x")).alias("x")), state, 0.25, 4)
    got = {r.row: r.x for r in turned.collect()}
    assert abs(got[0] - math.cos(1)) < 1e-3 and abs(got[1] - math.sin(1)) < 1e-3


def test_operators_with_columns():
    x = F.lit(1.0)
    op = Operator.derivative(1, 0) * x + Operator.derivative(1, 0)
    assert list(op.terms) == [(1, 0)] and Operator.laplacian(2) * Operator.laplacian(2) is not None
    assert (Operator.laplacian(2) * Operator.laplacian(2)).terms == {(4, 0): 1.0, (2, 2): 2.0, (0, 4): 1.0}
    with pytest.raises(ValueError):
        Operator.derivative(0, 1) * op


def test_places_and_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(i), float(v), float(w)) for i, (v, w) in enumerate(rng.random((300, 2)))], "id long, x0 double, x1 double").repartition(5)
    places = nodes.numbered(df, "x0").orderBy("place").toPandas()
    assert places["place"].tolist() == list(range(300)) and places["x0"].is_monotonic_increasing
    assert nodes.numbered(df.limit(0), "x0").collect() == []
    nodes.save_points(df, str(tmp_path / "points"), files=4)
    back = spark.read.parquet(str(tmp_path / "points"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())) and back.columns == df.columns


def test_required_hit(spark):
    dom = nodes.as_domain(spark, P.square())
    segments = spark.createDataFrame([(0, 0.5, 0.5, 2.0, 0.5), (1, 0.4, 0.4, 0.5, 0.5)], "id long, a0 double, a1 double, b0 double, b1 double")
    assert dom.first_hit(segments.where("id = 0"), required=True).count() == 1
    with pytest.raises(ValueError):
        dom.first_hit(segments, required=True)

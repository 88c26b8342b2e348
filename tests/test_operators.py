import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import fd, geometry, gp, interpolate, linalg, nodes, pairs, sparse
from pointloom.sources import points as P
from pointloom.sources.halton import GlobalHaltonSequence, HaltonSequence, halton, primes

RNG = np.random.default_rng(1)


def frame(spark, x, **more):
    x = np.asarray(x, float)
    names = ", ".join([f"x{k} double" for k in range(x.shape[1])] + [f"{n} double" for n in more])
    return spark.createDataFrame([(i, *map(float, r), *(float(v[i]) for v in more.values())) for i, r in enumerate(x)], "id long, " + names)


def halton_array(n, dim, start=0):
    out = np.zeros((n, dim))
    for k, b in enumerate(primes(dim)):
        for i in range(n):
            f, j = 1.0, start + 1 + i
            while j:
                f, (j, d) = f / b, divmod(j, b)
                out[i, k] += f * d
    return out


def test_halton(spark):
    rows = halton(spark, 200, 3, start=5).orderBy("id").toPandas()
    assert np.allclose(rows[["x0", "x1", "x2"]], halton_array(200, 3, 5))
    h = HaltonSequence(spark, 1)
    both = [r.x0 for q in (h.random(3), h(2)) for r in q.orderBy("id").collect()]
    assert np.allclose(both, halton_array(5, 1)[:, 0])
    a, b = GlobalHaltonSequence(spark), GlobalHaltonSequence(spark)
    a.random(4)
    assert b.random(1).first().x0 != halton_array(1, 1, 100)[0, 0]


def test_neighbours_and_radius(spark):
    x, y = RNG.random((90, 2)), RNG.random((60, 2)) * 3
    d2 = ((y[:, None] - x[None]) ** 2).sum(-1)
    near = {(r.i, r["rank"]): r.j for r in pairs.knn(frame(spark, y), frame(spark, x), 4, brute_rows=0).collect()}
    assert len(near) == 240 and all(near[i, k + 1] == j for i in range(60) for k, j in enumerate(np.argsort(d2[i], kind="stable")[:4]))
    assert pairs.radius_join(frame(spark, y), frame(spark, x), 0.3).count() == int((d2 <= 0.09).sum())
    with pytest.raises(ValueError):
        pairs.knn(frame(spark, y), frame(spark, x[:2]), 3)
    twin = frame(spark, [[0, 0], [0, 0], [1, 0]])
    assert [r.distance for r in pairs.nearest_distance(twin).orderBy("i").collect()] == [0, 0, 1]


def coo(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)], "row long, col long, value double")


def test_sparse_matrices(spark):
    a = RNG.random((20, 8)) * (RNG.random((20, 8)) < 0.4)
    dense = lambda df, n=20, m=8: linalg.to_dense(df, n, m)
    norms = {r["row"]: r["norm"] for r in sparse.row_norms(coo(spark, a), 3).collect()}
    assert all(math.isclose(v, (np.abs(a[i]) ** 3).sum() ** (1 / 3)) for i, v in norms.items())
    x = spark.createDataFrame([(i, 1.0 + i) for i in range(20)], "row long, x double")
    assert np.allclose(dense(sparse.divide_rows(coo(spark, a), x)), a / (1 + np.arange(20))[:, None])
    places = spark.createDataFrame([(i, 19 - i) for i in range(20)], "row long, new long")
    assert np.allclose(dense(sparse.add_rows(coo(spark, a), coo(spark, a), places)), a + a[::-1])
    assert np.allclose(dense(sparse.matmul(coo(spark, a), sparse.transpose(coo(spark, a))), 20, 20), a @ a.T)
    tiles = sparse.block([(coo(spark, a), 0, 0), (sparse.diagonal(x), 0, 8)])
    assert np.allclose(dense(tiles, 20, 28), np.hstack([a, np.diag(1.0 + np.arange(20))]))


def test_dense_solvers():
    a = RNG.random((12, 12))
    spd, b, v, w = a @ a.T + np.eye(12), RNG.random((12, 3)), RNG.random(12), RNG.random(3)
    whole = np.block([[spd, b], [b.T, np.zeros((3, 3))]])
    want = np.linalg.solve(whole, np.concatenate([v, w]))
    for kind in (linalg.PartitionedSolver, linalg.PartitionedPosDefSolver):
        for inverse in (False, True):
            x, y = kind(spd, b, build_inverse=inverse).solve(v, w)
            assert np.allclose(np.concatenate([x, y]), want)
    s = linalg.PosDefSolver(spd, build_inverse=True)
    assert np.allclose(s.solve(v), np.linalg.solve(spd, v)) and math.isclose(s.log_det(), np.linalg.slogdet(spd)[1])
    assert np.allclose(s.L() @ s.L().T, spd) and np.allclose(s.L() @ s.solve_L(v), v)
    assert np.allclose(linalg.Solver(a, True, True).solve(v), np.linalg.solve(a, v))
    assert linalg.is_positive_definite(spd) and not linalg.is_positive_definite(-spd)
    with pytest.raises(np.linalg.LinAlgError):
        linalg.PartitionedSolver(np.eye(2), np.ones((2, 3)))
    found, _ = linalg.nelder_mead(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, [0.0, 0.0])
    assert np.allclose(found, [1, -2], atol=1e-2)


def test_iterative_solvers(spark):
    n = 12
    a = np.diag(np.full(n, 4.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -1.0), -1)
    b = RNG.random(n)
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "row long, value double")
    got = linalg.cg(coo(spark, a), right).orderBy("row").toPandas()["x"]
    assert np.allclose(got, np.linalg.solve(a, b), atol=1e-6)
    a[0, 5] = 0.7
    small = linalg.gmres(coo(spark, a[:6, :6]), right.where("row < 6"), restart=8, rounds=2).orderBy("row").toPandas()["x"]
    assert np.allclose(small, np.linalg.solve(a[:6, :6], b[:6]), atol=1e-5)


def test_geometry_examples(spark):
    sq = geometry.Domain(*P.complex_frames(spark, *P.square()))
    seg = spark.createDataFrame([(0, .5, .5, .5, 1.5), (1, .5, .5, .9, .9), (2, .5, -1., .5, 1.5), (3, .5, -1., 1., -1.)], "id long, a0 double, a1 double, b0 double, b1 double")
    assert [r["count"] for r in sq.intersection_count(seg).orderBy("id").collect()] == [1, 0, 2, 0]
    hit = sq.first_hit(seg).orderBy("id").collect()
    assert (hit[0].h0, hit[0].h1, hit[0].s_id) == (0.5, 1.0, 2) and hit[1].s_id is None and (hit[2].h1, hit[2].s_id) == (0.0, 0)
    pts = frame(spark, [[.5, .5], [-.5, .5], [.5, -.5], [.5, 1.5], [1.5, .5]])
    assert [r.inside for r in sq.contains(pts).orderBy("id").collect()] == [True, False, False, False, False]
    near = sq.nearest(frame(spark, [[1.1, .5], [.1, .5]])).orderBy("id").collect()
    assert [(r.s_id, r.n0, r.n1) for r in near] == [(1, 1.0, 0.5), (3, 0.0, 0.5)]
    flat = geometry.Domain(*P.complex_frames(spark, [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], [[0, 1, 2], [0, 2, 3]]))
    three = spark.createDataFrame([(0, .5, .25, -1., .5, .25, 1.), (1, .5, .5, -1., .5, .5, 1.), (2, .5, .25, 2., .5, .25, 1.)], "id long, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    assert [r["count"] for r in flat.intersection_count(three).orderBy("id").collect()] == [1, 2, 0]
    near = flat.nearest(frame(spark, [[1.1, .5, 1], [.1, .5, -1], [-.1, .5, 0]])).orderBy("id").collect()
    assert [(r.s_id, round(r.n0, 9), r.n1, r.n2) for r in near] == [(0, 1.0, 0.5, 0.0), (1, 0.1, 0.5, 0.0), (1, 0.0, 0.5, 0.0)]


def test_sphere_inside_and_volume(spark):
    ball = geometry.Domain(*P.complex_frames(spark, *P.sphere(3)))
    x = halton_array(3000, 3) * 2 - 1
    got = [r.inside for r in ball.contains(frame(spark, x)).orderBy("id").collect()]
    r = np.linalg.norm(x, axis=1)
    assert all(g == (v < 1) for g, v in zip(got, r, strict=True) if abs(v - 1) > 0.02)
    assert abs(ball.volume().first()[0] - 4 / 3 * math.pi) < 0.1
    v, s = P.sphere(1)
    mixed = geometry.Domain(*P.complex_frames(spark, v, [t[::-1] if i % 3 else t for i, t in enumerate(s)]))
    assert math.isclose(mixed.oriented().volume().first()[0], geometry.Domain(*P.complex_frames(spark, v, s)).volume().first()[0])


def test_interpolation(spark):
    y, x = halton_array(500, 2), halton_array(200, 2, 700)
    f = lambda p: np.sin(p[:, 0]) * np.cos(p[:, 1])
    sites = frame(spark, y, d=f(y))
    get = lambda df: df.orderBy("id").toPandas()["d"].to_numpy()
    assert np.allclose(get(interpolate.RBFInterpolant(sites, order=3)(frame(spark, x))), f(x), atol=1e-2)
    assert np.allclose(get(interpolate.RBFInterpolant(sites, order=3)(frame(spark, x), (1, 0))), np.cos(x[:, 0]) * np.cos(x[:, 1]), atol=1e-2)
    assert np.allclose(get(interpolate.RBFInterpolant(sites, neighbors=20)(frame(spark, x))), f(x), atol=1e-2)
    noisy = frame(spark, y, d=np.where(np.arange(500) == 7, 100, 0) + f(y), s=np.where(np.arange(500) == 7, 1e3, 0))
    assert np.allclose(get(interpolate.RBFInterpolant(noisy, sigma="s")(frame(spark, x))), f(x), atol=1e-2)
    auto = interpolate.RBFInterpolant(frame(spark, y[:40], d=f(y[:40])), phi="se", sigma=1e-3, eps="auto")
    assert auto.eps > 0 and np.allclose(get(auto(frame(spark, x))), f(x), atol=5e-2)
    assert interpolate.cross_validate(sites.where("id < 60"), 5, phi="phs3", order=1).agg(F.max("rmse")).first()[0] < 0.05
    with pytest.raises(ValueError):
        interpolate.RBFInterpolant(sites.where("id < 3"), order=3)


def test_scores_match_refits():
    y, d = RNG.random((20, 2)), RNG.random((20, 2))
    k = interpolate.get_kernel("ga")
    err = []
    for i in range(20):
        keep = np.arange(20) != i
        fit = interpolate.solve_systems(y[keep], d[keep], np.full(19, 0.1), k, 2.0, 1)
        err.append(interpolate.evaluate(y[i : i + 1], y[keep], *fit, k, 2.0, 1, None)[0] - d[i])
    assert math.isclose(interpolate.loocv(y, d, 0.1, "ga", 2.0, 1), np.linalg.norm(err), rel_tol=1e-6)
    assert interpolate.gml(y, d, 0.1, "ga", 2.0, 1) > 0


def test_weights(spark):
    s = np.array([[0, 0], [1, 0], [0, 1.0]])
    for phi in ("phs2", "phs3", "phs5", "phs8"):
        assert math.isclose(fd.weights([0.25, 0.25], s, (1, 0), phi=phi) @ [0, 2, 3], 2, rel_tol=1e-8)
    assert np.allclose(fd.weights([1.0], np.array([[0.0], [1], [2]]), (2,)), [1, -2, 1])
    with pytest.raises(ValueError):
        fd.weights([0.2, 0.2], s, (1, 0), order=2)
    g = P.grid(spark, [0, 0, 0], [1, 1, 1], [5, 5, 5])
    m = fd.body_force(g, g, 30)
    u = g.select(F.col("id").alias("col"), (F.col("x0") * F.col("x1")).alias("x"))
    assert np.allclose(sparse.matvec(m["yx"], u).toPandas()["value"], 2.0, atol=1e-6)
    n = g.withColumn("n0", F.lit(1.0)).withColumn("n1", F.lit(0.0)).withColumn("n2", F.lit(0.0))
    t = fd.surface_force(n, ["n0", "n1", "n2"], g, 20)
    assert np.allclose(sparse.matvec(t["xx"], g.select(F.col("id").alias("col"), F.col("x0").alias("x"))).toPandas()["value"], 3.0, atol=1e-6)


def test_gaussian_processes(spark):
    y = np.linspace(0, 10, 150)[:, None]
    rng = np.random.default_rng(3)
    d = np.sin(y[:, 0]) + 0.1 * rng.standard_normal(150)
    prior = gp.gpiso("se", 2.0, 2.0)
    post = prior.condition(y, d, np.full(150, 0.1))
    x = np.linspace(0.5, 9.5, 60)[:, None]
    mean, sd = post(x)
    assert abs(np.log10(np.sqrt((((mean - np.sin(x[:, 0])) / sd) ** 2).mean()))) < 0.5
    assert np.allclose(post.variance(x), np.diag(post.covariance(x, x)), atol=1e-9)
    assert np.allclose(post.mean(x, (1,)), (post.mean(x + 1e-5) - post.mean(x - 1e-5)) / 2e-5, atol=1e-3)
    assert np.allclose((prior | (y, d, np.full(150, 0.1))).mean(x), mean)
    both = (gp.gppoly(1) + prior - gp.gpiso("exp", 1.0, 0.5)) * 2
    assert both.basis(x).shape == (60, 2) and np.allclose(both.covariance(x, x), 4 * (prior.covariance(x, x) + 0.5 * np.exp(-np.abs(x - x.T))))
    rows = post.score(frame(spark, x)).orderBy("id").toPandas()
    assert np.allclose(rows["mean"], mean) and np.allclose(rows["sd"], sd)
    bad = d.copy()
    bad[[20, 70]] += 9
    assert np.flatnonzero(prior.outliers(y, bad, 0.1)).tolist() == [20, 70]
    assert not gp.gppoly(0).outliers(y, np.ones(150), 1.0).any()
    a = gp.gpgibbs(lambda q: 1 + 0 * q, 1.0)
    assert np.allclose(a.covariance(x, x), np.exp(-((x - x.T) ** 2) / 2)) and a.is_positive_definite(x[::20])
    assert prior.sample(x, count=3).shape == (3, 60) and np.allclose(prior.sample(x, seed=1), prior.sample(x, seed=1))
    full = gp.log_likelihood(d, 0 * d, prior.covariance(y, y) + 0.01 * np.eye(150))
    assert math.isclose(prior.log_likelihood(y, d, np.full(150, 0.1)), full)
    with pytest.raises(ValueError):
        gp.GaussianProcess(variance=lambda x, d: x)


def test_nodes(spark):
    dom = nodes.as_domain(spark, P.square())
    made = nodes.min_energy_nodes(spark, 60, dom, iterations=1, boundary_groups={"bottom": [0], "rest": [1, 2, 3]}, ghosts=["bottom"])
    rows = made.toPandas()
    assert sorted(rows["id"]) == list(range(len(rows))) and (rows["grp"] == "interior").any()
    bottom, ghosts = rows[rows["grp"] == "boundary:bottom"], rows[rows["grp"] == "ghosts:bottom"]
    assert len(bottom) == len(ghosts) and (bottom["x1"].abs() < 1e-9).all() and (ghosts["x1"] < 0).all() and np.allclose(bottom["n1"], -1)
    with pytest.raises(ValueError):
        nodes.prepare_nodes(made.select("id", "x0", "x1"), dom, iterations=0, boundary_groups={"a": [9]})
    assert nodes.group_indices(made).count() == rows["grp"].nunique()

import numpy as np
import pytest

from pointloom.functions.kernels import get_kernel
from pointloom.functions.polynomials import monomials
from pointloom.operators import compact, factors, interpolate
from pointloom.plans import queries


def test_tiles_of_a_band_give_the_dense_solution(monkeypatch):
    monkeypatch.setattr(factors, "TILE", 16)
    rng = np.random.default_rng(8)
    y = np.concatenate([rng.random((120, 2)), rng.random((7, 2)) + [3, 0]])  # a gap wider than the support
    kernel, p, d = get_kernel("wen31"), monomials(y, 1), rng.random((127, 2))
    band = factors.Band(y, 0.01, kernel, 0.3)
    assert len(set(band.first)) > 3
    a, b = factors.SparsePartitionedSolver(band, p).solve(d)
    want = np.linalg.solve(np.block([[kernel.array(y, y, 0.3) + 0.01 * np.eye(127), p], [p.T, np.zeros((3, 3))]]), np.concatenate([d, np.zeros((3, 2))]))
    assert np.allclose(a, want[:127], atol=1e-8) and np.allclose(b, want[127:], atol=1e-8)
    with pytest.raises(np.linalg.LinAlgError):
        factors.BandSolver(factors.Band(np.repeat(y, 2, 0), -0.5, kernel, 0.3))


@pytest.mark.parametrize("name", ["compact_at_sites", "compact_plane_slope"])
def test_factors_take_a_band_not_whole_strips(spark, tmp_path, monkeypatch, name):
    """Strips as wide as the support would make 49,465 numbers of 500 sites, their band makes 29,712."""
    monkeypatch.setattr(factors, "TILE", 8, raising=False)
    monkeypatch.setattr(compact, "STRIP_NUMBERS", 40_000)
    monkeypatch.setattr(compact, "sparse_pairs", None)
    rng = np.random.default_rng(9)
    x = (rng.random((500, 2)) - 0.5).astype("float32")
    spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype(float)
    want = np.sin(3 * x[:, 0]) + x[:, 1] if name == "compact_at_sites" else np.full(500, 3.0)
    got = {r.id: r.d for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    strips = factors.Strips(x, 0.0, get_kernel("wen30"), 0.1)
    assert strips.numbers > compact.STRIP_NUMBERS and len(got) == 500 and max(abs(got[i] - v) for i, v in enumerate(want)) < 2e-5


def test_bands_have_inverse_diagonals_and_determinants(monkeypatch):
    monkeypatch.setattr(factors, "TILE", 16)
    y = np.random.default_rng(10).random((150, 2))
    a = get_kernel("wen31").array(y, y, 0.3) + 0.01 * np.eye(150)
    solver = factors.BandSolver(factors.Band(y, 0.01, get_kernel("wen31"), 0.3), 1)
    assert np.allclose(solver.inverse_diagonal(), np.diag(np.linalg.inv(a))) and np.isclose(solver.log_det(), np.linalg.slogdet(a)[1])


@pytest.mark.parametrize("method", ["gml", "loocv"])
def test_grids_score_fits_whose_sites_reach_one_another(spark, tmp_path, monkeypatch, method):
    """Every row of the grid has a score of its own, by pairs and by a band, also where balances repeat."""
    x = np.round(np.random.default_rng(11).random(80) * 300, 2)
    x[70:] = x[:10]
    spark.createDataFrame([(3 * i, float(v)) for i, v in enumerate(x)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    line = np.array([float(sum(x[:i] == x[i])) for i in range(80)])
    y, d = np.stack([x / 1000, line], 1), np.sin(x / 1000)
    duck = pytest.importorskip("duckdb").connect()
    duck.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    sql = {r[:2]: r[2] for r in duck.sql(queries.ORACLES[f"{method}_grid"]).fetchall()}
    for most in (interpolate.MOST_ENTRIES, 100):
        monkeypatch.setattr(interpolate, "MOST_ENTRIES", most)
        monkeypatch.setattr(interpolate, "MOST_SITES", 30)
        got = {(r.sigma, r.eps): r.score for r in queries.QUERIES[f"{method}_grid"](spark, str(tmp_path)).collect()}
        want = {(s, e): getattr(interpolate, method)(y, d, s, "wen11", e, 0) for s, e in got}
        assert len(got) == 40 == len(set(got.values())) and got.keys() == sql.keys()
        assert all(abs(got[k] - v) < 2e-6 and abs(sql[k] - v) < 2e-6 for k, v in want.items())

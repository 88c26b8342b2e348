"""Interpolation of scattered values: one system for all sites, or one for each neighbourhood of k sites.

Global fits gather up to MOST_SITES sites and share the coefficients with all executors; local fits join neighbours and solve
neighbourhoods in Arrow batches, each distinct one once a batch; those that don't determine the monomials, as all their sites lie on a
line, take the nearest further sites that do. Evaluation never shuffles the targets of a global fit. Scores and folds
of kernels with a support gather the pairs within it, up to MOST_ENTRIES, and factor sparse systems, whatever the number of sites.
"""

from __future__ import annotations

import contextlib
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.kernels import get_kernel
from pointloom.functions.polynomials import monomial_count, monomial_powers, monomials
from pointloom.operators.factors import MOST_ENTRIES, Band, BandSolver, Entries, SparsePartitionedSolver, SparsePosDefSolver
from pointloom.operators.linalg import _kept, nelder_mead
from pointloom.operators.pairs import knn, radius_join
from pointloom.sources.points import coordinates

MOST_SITES = 5000
#: Numbers of a band's factor in a task that scores (half a gigabyte), and sites gathered for it.
BAND_NUMBERS, BAND_SITES = 60_000_000, 1_000_000
#: Singular values below that share of the largest count as none.
RANK = 1e-9


def _kernel(phi):
    return get_kernel(phi) if isinstance(phi, str) else phi


def default_order(kernel, order: int | None) -> int:
    least = kernel.cpd_order - 1
    if order is None:
        return max(least, 0)
    if order < -1:
        raise ValueError("the order is at least -1")
    if order < least:
        warnings.warn(f"an order below {least} may make the system singular", stacklevel=3)
    return order


def solve_systems(y, d, sigma, kernel, eps, order):
    """Coefficients (..., N, S) and (..., P, S), shift and scale (..., D) for sites y (..., N, D) and values d (..., N, S)."""
    low, high = y.min(-2), y.max(-2)
    shift, scale = (low + high) / 2, (high - low) / 2
    scale = np.where(scale > 0, scale, 1.0)
    n, powers = y.shape[-2], monomial_powers(order, y.shape[-1])
    if len(powers) > n:
        raise ValueError(f"{n} sites can't determine {len(powers)} monomials")
    k = kernel.array(y, y, eps)
    size = np.ptp(k, axis=(-2, -1))[..., None, None] if n > 1 else np.ones((*k.shape[:-2], 1, 1))
    size = np.where(size > 0, size, 1.0)
    p = monomials((y - shift[..., None, :]) / scale[..., None, :], powers) * size
    top = np.concatenate([k + np.eye(n) * (sigma**2)[..., None, :], p], -1)
    low_part = np.concatenate([np.swapaxes(p, -1, -2), np.zeros((*k.shape[:-2], len(powers), len(powers)))], -1)
    right = np.concatenate([d, np.zeros((*d.shape[:-2], len(powers), d.shape[-1]))], -2)
    c = np.linalg.solve(np.concatenate([top, low_part], -2), right)
    return c[..., :n, :], c[..., n:, :] * size, shift, scale


def _unit(y):
    """Sites (..., N, D) moved into the box from -1 to 1."""
    low, high = y.min(-2, keepdims=True), y.max(-2, keepdims=True)
    return (y - (low + high) / 2) / np.where(high > low, (high - low) / 2, 1.0)


def further_sites(y, k: int, order: int) -> list[int] | None:
    """Places, from k on, of the first sites that with the first k determine the monomials; None if all sites of y (N, D) don't."""
    p = monomials(_unit(y), order)
    _, s, v = np.linalg.svd(p[:k])
    open_ways, found = v[int((s > RANK * s[0]).sum()) :].T, []
    while open_ways.shape[1]:
        beyond = np.linalg.norm(p @ open_ways, axis=1) > RANK * s[0]
        beyond[:k] = False
        if not beyond.any():
            return None
        found.append(int(beyond.argmax()))
        w = p[found[-1]] @ open_ways
        open_ways = open_ways @ np.linalg.svd(w[None])[2][1:].T
    return found


def evaluate(x, y, a, b, shift, scale, kernel, eps, order, diff):
    """(..., M, S) values at x (..., M, D)."""
    powers = monomial_powers(order, x.shape[-1])
    p = monomials((x - shift[..., None, :]) / scale[..., None, :], powers, diff)
    if diff:
        p = p / np.prod(scale ** np.array(diff), axis=-1)[..., None, None]
    return kernel.array(x, y, eps, diff) @ a + p @ b


def _objective(method: str, y, d, sigma, kernel, eps, order) -> float:
    if kernel.sparse:
        raise NotImplementedError("scores of compact kernels: use their dense form")
    n = len(y)
    k = kernel.array(y, y, eps) + np.diag(np.broadcast_to(sigma, n) ** 2)
    p = monomials(y, order)
    m = p.shape[1]
    if method == "loocv":
        whole = np.block([[k, p], [p.T, np.zeros((m, m))]])
        try:
            inverse = np.linalg.inv(whole)
        except np.linalg.LinAlgError:
            return math.inf
        return float(np.linalg.norm((inverse[:n, :n] @ d) / np.diag(inverse)[:n, None]))
    q = np.linalg.qr(p, mode="complete")[0][:, m:]
    try:
        factor = np.linalg.cholesky(q.T @ k @ q)
    except np.linalg.LinAlgError:
        return math.nan
    w = np.linalg.solve(factor, q.T @ d)
    return float((w**2).sum() * math.exp(2 * np.log(np.diag(factor)).sum() / (n - m)))


def loocv(y, d, sigma=0.0, phi="phs3", eps=1.0, order=None) -> float:
    """Norm of leave-one-out errors."""
    kernel = _kernel(phi)
    return _objective("loocv", *_arrays(y, d, sigma), kernel, eps, default_order(kernel, order))


def gml(y, d, sigma=0.0, phi="phs3", eps=1.0, order=None) -> float:
    """Generalised maximum likelihood score; NaN where the projected matrix isn't positive definite."""
    kernel = _kernel(phi)
    return _objective("gml", *_arrays(y, d, sigma), kernel, eps, default_order(kernel, order))


def _arrays(y, d, sigma):
    y, d = np.asarray(y, float), np.asarray(d, float)
    return y, d.reshape(len(y), -1), np.broadcast_to(np.asarray(sigma, float), len(y))


def best_parameters(y, d, phi, eps, order, sigma, method: str = "loocv") -> tuple[float, float]:
    """(sigma, eps) with "auto" replaced by what a simplex search on their logarithms finds."""
    kernel = _kernel(phi)
    y, d = np.asarray(y, float), np.asarray(d, float).reshape(len(y), -1)
    gaps = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)) + np.where(np.eye(len(y)) > 0, np.inf, 0)
    mean_gap = float(gaps.min(1).mean())
    first = {"sigma": 1.0, "eps": 2 * mean_gap if kernel.divides else 1 / (2 * mean_gap)}
    free = [n for n, v in (("sigma", sigma), ("eps", eps)) if isinstance(v, str)]

    def score(logs):
        v = {"sigma": sigma, "eps": eps} | dict(zip(free, np.exp(logs), strict=True))
        s = _objective(method, y, d, np.full(len(y), float(v["sigma"])), kernel, float(v["eps"]), default_order(kernel, order))
        return s if math.isfinite(s) else 1e300

    found, _ = nelder_mead(score, [math.log(first[n]) for n in free])
    v = {"sigma": sigma, "eps": eps} | dict(zip(free, np.exp(found).tolist(), strict=True))
    return v["sigma"], v["eps"]


class RBFInterpolant:
    """Fits sites (id, x0.., values, optionally a column of standard deviations) and evaluates at points."""

    def __init__(self, sites: DataFrame, values: list[str] | str = "d", sigma: float | str = 0.0, phi="phs3", eps: float | str = 1.0, order: int | None = None, neighbors: int | None = None):
        self.values = [values] if isinstance(values, str) else list(values)
        self.sites, self.kernel, self.x = sites, _kernel(phi), coordinates(sites)
        self.sigma_column = sigma if isinstance(sigma, str) and sigma != "auto" else None
        self.order = default_order(self.kernel, order)
        n = sites.count()
        self.neighbors = None if neighbors is None else min(neighbors, n)
        used = n if neighbors is None else self.neighbors
        if used < monomial_count(self.order, len(self.x)):
            raise ValueError(f"{used} sites can't determine {monomial_count(self.order, len(self.x))} monomials")
        if neighbors is None and n > MOST_SITES:
            raise ValueError(f"{n} sites are too many for one system; give neighbors")
        if "auto" in (sigma, eps) and n > MOST_SITES:
            raise ValueError(f"{n} sites are too many to choose sigma or eps by; give both")
        self.sigma, self.eps = sigma, eps
        if neighbors is None or "auto" in (sigma, eps):
            rows = sites.orderBy("id").limit(MOST_SITES).toPandas()
            y, d = rows[self.x].to_numpy(float), rows[self.values].to_numpy(float)
            s = rows[self.sigma_column].to_numpy(float) if self.sigma_column else sigma
            if "auto" in (sigma, eps):
                self.sigma, self.eps = best_parameters(y, d, self.kernel, eps, order, s)
                s = self.sigma
            if neighbors is None:
                self.fit = (y, *solve_systems(y, d, np.broadcast_to(np.asarray(s, float), len(y)), self.kernel, self.eps, self.order))

    def __call__(self, points: DataFrame, diff: tuple[int, ...] | None = None) -> DataFrame:
        """id and the values (or their derivatives) at points."""
        out = "id bigint, " + ", ".join(f"`{v}` double" for v in self.values)
        return self._local(points, diff, out) if self.neighbors else self._global(points, diff, out)

    def _global(self, points, diff, kind):
        shared = points.sparkSession.sparkContext.broadcast((*self.fit, self.kernel, self.eps, self.order, diff, self.x, self.values))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            y, a, b, shift, scale, kernel, eps, order, d, x, names = shared.value
            for rows in batches:
                for at in range(0, len(rows), 1000):
                    part = rows.iloc[at : at + 1000]
                    v = evaluate(part[x].to_numpy(float), y, a, b, shift, scale, kernel, eps, order, d)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), **{n: v[:, i] for i, n in enumerate(names)}})

        return points.select("id", *self.x).mapInPandas(run, kind)

    def _determined(self, points, near):
        """(i, j) of near, and for each neighbourhood that lacks rank the nearest sites beyond it that add to its rank."""
        if self.order < 1:
            return near.select("i", "j")
        k, x, order = self.neighbors, self.x, self.order
        own = self.sites.select(F.col("id").alias("j"), *x)

        def further(near, pick):
            by = near.join(own, "j").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "j", *x))).alias("s"))
            return _kept(by.select("i", *(F.col("s")[c].alias(c) for c in ("j", *x))).mapInPandas(lambda batches: map(pick, batches), "i bigint, j bigint, lacks boolean"))

        def pick(rows):
            out = {"i": [], "j": [], "lacks": []}
            if len(rows):
                first = np.stack([np.stack([v[:k] for v in rows[c]]) for c in x], -1)
                rows = rows[np.linalg.matrix_rank(monomials(_unit(first), order), rtol=RANK) < monomial_count(order, len(x))]
            for i, ids, *y in zip(rows["i"], rows["j"], *(rows[c] for c in x), strict=True):
                found = further_sites(np.stack(y, -1), k, order)
                for j in [ids[0]] if found is None else ids[found]:
                    for name, v in zip(out, (i, j, found is None), strict=True):
                        out[name].append(v)
            return pd.DataFrame(out).astype({"i": "int64", "j": "int64", "lacks": "bool"})

        near, total, wide = _kept(near), self.sites.count(), k
        more, out = further(near, pick), near.select("i", "j")
        while True:
            out = out.unionByName(more.where("NOT lacks").select("i", "j"))
            left = more.where("lacks").select(F.col("i").alias("id"))
            if left.limit(1).count() == 0:
                return out
            if wide >= total:
                raise ValueError(f"the sites don't determine the monomials up to degree {order}")
            wide = min(4 * wide, total)
            more = further(knn(points.select("id", *x).join(left, "id", "left_semi"), self.sites, wide).select("i", "rank", "j"), pick)

    def _local(self, points, diff, kind):
        k, x, names, kernel, eps, order = self.neighbors, self.x, self.values, self.kernel, self.eps, self.order
        near = self._determined(points, knn(points, self.sites, k).select("i", "rank", "j"))
        sigma = F.col(self.sigma_column) if self.sigma_column else F.lit(float(self.sigma))
        fields = [F.col(c).alias(c) for c in x] + [F.col(v).alias("v_" + v) for v in names] + [sigma.alias("sigma")]
        own = self.sites.select(F.col("id").alias("j"), *fields)
        site = F.struct("j", *(F.col(c) for c in own.columns if c != "j"))
        stencils = near.join(own, "j").groupBy("i").agg(F.sort_array(F.collect_list(site)).alias("s")).withColumnRenamed("i", "id")
        stencils = stencils.withColumn("key", F.array_join(F.transform("s", lambda v: v["j"].cast("string")), ","))
        flat = [F.col("s")[n].alias("s_" + n) for n in (*x, *("v_" + v for v in names), "sigma")]
        joined = points.select("id", *x).join(stencils, "id").select("id", *x, "key", *flat).repartition("key")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in (part for whole in batches for _, part in whole.groupby(whole["s_sigma"].map(len))):
                first = ~rows["key"].duplicated()
                index = pd.Series(np.arange(int(first.sum())), rows["key"][first])[rows["key"]].to_numpy()
                one = rows[first]
                y = np.stack([np.stack(one["s_" + c].to_numpy()) for c in x], -1)
                d = np.stack([np.stack(one["s_v_" + v].to_numpy()) for v in names], -1)
                a, b, shift, scale = solve_systems(y, d, np.stack(one["s_sigma"].to_numpy()), kernel, eps, order)
                p = rows[x].to_numpy(float)[:, None, :]
                v = evaluate(p, y[index], a[index], b[index], shift[index], scale[index], kernel, eps, order, diff)[:, 0]
                yield pd.DataFrame({"id": rows["id"].to_numpy(), **{n: v[:, i] for i, n in enumerate(names)}})

        return joined.mapInPandas(run, kind)


def k_nearest(sites: DataFrame, values="d", k: int = 20, **how) -> RBFInterpolant:
    """The local form by its older name."""
    return RBFInterpolant(sites, values, neighbors=k, **how)


def _gathered(sites: DataFrame, values: str, kernel, eps: float, banded: bool = False):
    """Coordinates and values of all sites by id, and the places (i, j) of the pairs within eps times the support.

    The pairs are None where the kernel has no support or they are over MOST_ENTRIES; then sites are refused beyond MOST_SITES. With banded
    they are an empty tuple instead where pairs are too many, but not the numbers of a band of the sites.
    """
    x, near, most = coordinates(sites), None, MOST_SITES
    if kernel.supp is not None:
        got = radius_join(sites, sites, kernel.supp * eps).select("i", "j").limit(MOST_ENTRIES + 1).toArrow()
        if got.num_rows <= MOST_ENTRIES:
            near, most = [got.column(c).to_numpy() for c in ("i", "j")], MOST_ENTRIES
        elif banded:
            most = BAND_SITES
    rows = sites.orderBy("id").limit(most + 1).toPandas()
    if near is None and most == BAND_SITES:
        near, most = ((), most) if Band(rows[x].to_numpy(float), 0.0, kernel, eps).numbers <= BAND_NUMBERS else (None, MOST_SITES)
    if len(rows) > most:
        raise ValueError(f"more than {most} sites")
    if near:
        ids = rows["id"].to_numpy()
        if (ids[1:] == ids[:-1]).any():
            raise ValueError("ids repeat")
        near = [np.searchsorted(ids, v) for v in near]
    return rows[x].to_numpy(float), rows[[values]].to_numpy(float), near


def _entries(y, near, sigma, kernel, eps) -> Entries:
    """The kernel matrix of y from the pairs within its support, and variances on the diagonal."""
    i, j = near
    v, own = kernel.array(y[i][:, None], y[j][:, None], eps)[:, 0, 0], np.arange(len(y))
    s = np.broadcast_to(np.asarray(sigma, float), len(y))
    return Entries(np.concatenate([i[v != 0], own]), np.concatenate([j[v != 0], own]), np.concatenate([v[v != 0], s**2]), len(y))


def _sparse_objective(method: str, y, d, near, sigma, kernel, eps, order) -> float:
    """_objective of a sparse system: K alone is factored, the monomials follow by a Schur complement. Few sites of an indefinite K: dense."""
    p = monomials(y, order)
    n, m = p.shape
    try:
        k = SparsePosDefSolver(_entries(y, near, sigma, kernel, eps)) if near else BandSolver(Band(y, sigma**2, kernel, eps), 1)
        kp, w = k.solve(p), k.solve(d)
        schur = p.T @ kp
        w = w - kp @ np.linalg.solve(schur, p.T @ w)
        if method == "loocv":
            diagonal = k.inverse_diagonal() - (kp * np.linalg.solve(schur, kp.T).T).sum(1)
            return float(np.linalg.norm(w / diagonal[:, None]))
        size = k.log_det() + np.linalg.slogdet(schur)[1] - np.linalg.slogdet(p.T @ p)[1]
        return float((d * w).sum() * math.exp(size / (n - m)))
    except np.linalg.LinAlgError:
        if n <= MOST_SITES and not kernel.sparse:
            return _objective(method, y, d, sigma, kernel, eps, order)
        return math.inf if method == "loocv" else math.nan


def _sparse_fold(y, d, near, held, sigma, kernel, eps, order):
    """Values at the held sites of the sparse fit of the others."""
    (i, j), place = near, np.cumsum(~held) - 1
    inside, across = ~held[i] & ~held[j], held[i] & ~held[j]
    own, middle, half = y[~held], (y.min(0) + y.max(0)) / 2, np.ptp(y, axis=0) / 2
    p = monomials((y - middle) / np.where(half > 0, half, 1.0), order)
    k = _entries(own, (place[i[inside]], place[j[inside]]), sigma, kernel, eps)
    a, b = SparsePartitionedSolver(k, p[~held]).solve(d[~held])
    out, i, j = p @ b, i[across], j[across]
    np.add.at(out, i, kernel.array(y[i][:, None], y[j][:, None], eps)[:, 0] * a[place[j]])
    return out[held]


def parameter_scores(sites: DataFrame, grid: DataFrame, values: str = "d", phi="phs3", order: int | None = None, method: str = "loocv") -> DataFrame:
    """(sigma, eps, score) for each row (sigma, eps) of grid, scored in parallel against the gathered sites."""
    kernel = _kernel(phi)
    degree = default_order(kernel, order)
    widest = 0.0 if kernel.supp is None else grid.agg(F.max(F.col("eps").cast("double"))).first()[0] or 0.0
    shared = sites.sparkSession.sparkContext.broadcast(_gathered(sites, values, kernel, widest, True))

    def run(batches):
        y, d, near = shared.value
        score = loocv if method == "loocv" else gml
        for g in batches:
            both = list(zip(g["sigma"], g["eps"], strict=True))
            if near is None:
                yield g.assign(score=[score(y, d, s, phi, e, order) for s, e in both])
            else:
                yield g.assign(score=[_sparse_objective(method, y, d, near, s, kernel, e, degree) for s, e in both])

    return grid.select(F.col("sigma").cast("double"), F.col("eps").cast("double")).mapInPandas(run, "sigma double, eps double, score double")


def cross_validate(sites: DataFrame, folds: int, values: str = "d", **how) -> DataFrame:
    """(fold, rmse): every folds-th site held out in turn; each fold is fitted in its own task."""
    kernel = _kernel(how.get("phi", "phs3"))
    eps, sigma, order = how.get("eps", 1.0), how.get("sigma", 0.0), default_order(kernel, how.get("order"))
    shared = sites.sparkSession.sparkContext.broadcast(_gathered(sites, values, kernel, eps))

    def run(batches):
        y, d, near = shared.value
        for g in batches:
            out = []
            for f in g["fold"]:
                held = np.arange(len(y)) % folds == f
                guess = None
                if near is not None:
                    with contextlib.suppress(np.linalg.LinAlgError if len(y) <= MOST_SITES else ()):
                        guess = _sparse_fold(y, d, near, held, sigma, kernel, eps, order)
                if guess is None:
                    fit = solve_systems(y[~held], d[~held], np.full(int((~held).sum()), sigma), kernel, eps, order)
                    guess = evaluate(y[held], y[~held], *fit, kernel, eps, order, None)
                out.append(float(np.sqrt(((guess - d[held]) ** 2).mean())))
            yield g.assign(rmse=out)

    return sites.sparkSession.range(folds).select(F.col("id").alias("fold")).repartition(folds).mapInPandas(run, "fold bigint, rmse double")

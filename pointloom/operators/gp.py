"""Gaussian processes: an immutable algebra of mean, covariance and basis functions, conditioned on gathered observations.

A process is built on the driver; conditioning factors one system of up to MOST observations; scoring points is distributed in Arrow
batches, and independent processes for the groups of a table are fitted one group a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.checks import Memoize, arg_count, assert_shape
from pointloom.functions.kernels import get_kernel
from pointloom.functions.polynomials import monomials
from pointloom.operators.linalg import PartitionedPosDefSolver, is_positive_definite
from pointloom.sources.points import coordinates

MOST = 5000


def _zero(d):
    return (0,) * d


def differentiator(delta: float):
    """Lets f(x) take derivatives by forward differences of width delta."""

    def wrap(f):
        def g(x, diff=None):
            i = next((i for i, a in enumerate(diff or ()) if a), None)
            if i is None:
                return f(x)
            lower, step = tuple(a - (j == i) for j, a in enumerate(diff)), np.zeros(x.shape[-1])
            step[i] = delta
            return (g(x + step, lower) - g(x, lower)) / delta

        return g

    return wrap


def covariance_differentiator(delta: float):
    """The same for f(x1, x2)."""

    def wrap(f):
        def g(x1, x2, diff1=None, diff2=None):
            for which, d in enumerate((diff1, diff2)):
                i = next((i for i, a in enumerate(d or ()) if a), None)
                if i is None:
                    continue
                lower, step = tuple(a - (j == i) for j, a in enumerate(d)), np.zeros(x1.shape[-1])
                step[i] = delta
                if which == 0:
                    return (g(x1 + step, x2, lower, diff2) - g(x1, x2, lower, diff2)) / delta
                return (g(x1, x2 + step, diff1, lower) - g(x1, x2, diff1, lower)) / delta
            return f(x1, x2)

        return g

    return wrap


def _with_diff(f, points: int):
    """f as a function of points and derivatives; one of points only has no derivatives."""
    if f is None or arg_count(f) > points:
        return f

    def plain(*args):
        if any(any(d) for d in args[points:]):
            raise ValueError("a function of points only can't be differentiated")
        return f(*args[:points])

    return plain


class GaussianProcess:
    """mean(x, diff), covariance(x1, x2, diff1, diff2), basis(x, diff), variance(x, diff), each optional; those without the derivatives as
    arguments can't be differentiated.
    """

    def __init__(self, mean=None, covariance=None, basis=None, variance=None, dim: int | None = None):
        if variance is not None and covariance is None:
            raise ValueError("a variance needs a covariance")
        self._mean, self._basis, self._var = (_with_diff(f, 1) for f in (mean, basis, variance))
        self._cov, self.dim = _with_diff(covariance, 2), dim

    def _at(self, x):
        x = np.asarray(x, float)
        if self.dim is not None and x.shape[-1] != self.dim:
            raise ValueError(f"points of dimension {x.shape[-1]}, not {self.dim}")
        return x

    def mean(self, x, diff=None):
        x = self._at(x)
        return np.zeros(len(x)) if self._mean is None else assert_shape(self._mean(x, tuple(diff or _zero(x.shape[1]))), (len(x),), "the mean")

    def covariance(self, x1, x2, diff1=None, diff2=None):
        x1, x2 = self._at(x1), self._at(x2)
        z = _zero(x1.shape[1])
        return np.zeros((len(x1), len(x2))) if self._cov is None else assert_shape(self._cov(x1, x2, tuple(diff1 or z), tuple(diff2 or z)), (len(x1), len(x2)), "the covariance")

    def variance(self, x, diff=None):
        x = self._at(x)
        diff = tuple(diff or _zero(x.shape[1]))
        if self._var is not None:
            return self._var(x, diff)
        return np.array([self.covariance(p[None], p[None], diff, diff)[0, 0] for p in x])

    def basis(self, x, diff=None):
        x = self._at(x)
        return np.zeros((len(x), 0)) if self._basis is None else assert_shape(self._basis(x, tuple(diff or _zero(x.shape[1]))), (len(x), None), "the basis")

    def _dim_with(self, other):
        if None not in (self.dim, other.dim) and self.dim != other.dim:
            raise ValueError("processes of different dimension")
        return self.dim if self.dim is not None else other.dim

    def add(self, other: GaussianProcess) -> GaussianProcess:
        def either(a, b, join):
            return a or b if not (a and b) else join

        var = (lambda x, d: self.variance(x, d) + other.variance(x, d)) if self._cov or other._cov else None
        return GaussianProcess(
            either(self._mean, other._mean, lambda x, d: self._mean(x, d) + other._mean(x, d)),
            either(self._cov, other._cov, lambda a, b, d, e: self._cov(a, b, d, e) + other._cov(a, b, d, e)),
            either(self._basis, other._basis, lambda x, d: np.hstack([self._basis(x, d), other._basis(x, d)])),
            var,
            self._dim_with(other),
        )

    def scale(self, c: float) -> GaussianProcess:
        return GaussianProcess(
            self._mean and (lambda x, d: c * self._mean(x, d)),
            self._cov and (lambda a, b, d, e: c * c * self._cov(a, b, d, e)),
            self._basis,
            self._cov and (lambda x, d: c * c * self.variance(x, d)),
            self.dim,
        )

    def subtract(self, other: GaussianProcess) -> GaussianProcess:
        """Of independent processes: covariances add."""
        return self.add(other.scale(-1.0))

    def differentiate(self, by) -> GaussianProcess:
        more = lambda d: tuple(a + b for a, b in zip(d, by, strict=True))
        return GaussianProcess(
            self._mean and (lambda x, d: self._mean(x, more(d))),
            self._cov and (lambda a, b, d, e: self._cov(a, b, more(d), more(e))),
            self._basis and (lambda x, d: self._basis(x, more(d))),
            self._cov and (lambda x, d: self.variance(x, more(d))),
            len(by),
        )

    __add__, __sub__, __mul__, __rmul__ = add, subtract, scale, scale

    def __or__(self, args):
        return self.condition(*args)

    def condition(self, y, d, dcov=None, dvecs=None, ddiff=None, build_inverse: bool = False) -> GaussianProcess:
        """Given noisy values d of the process, or of its derivative ddiff, at y; dcov: noise covariance or standard deviations."""
        y, d = self._at(y), np.asarray(d, float)
        ddiff = tuple(ddiff or _zero(y.shape[1]))
        cov = self.covariance(y, y, ddiff, ddiff) + _noise(dcov, len(y))
        own = self.basis(y, ddiff)
        extra = np.zeros((len(y), 0)) if dvecs is None else np.asarray(dvecs, float)
        solver = PartitionedPosDefSolver(cov, np.hstack([own, extra]), build_inverse)
        v1, v2 = solver.solve(d - self.mean(y, ddiff))
        m = own.shape[1]

        def wide(x, diff):
            return np.hstack([self.basis(x, diff), np.zeros((len(x), extra.shape[1]))])

        def mean(x, diff):
            return self.mean(x, diff) + self.covariance(x, y, diff, ddiff) @ v1 + self.basis(x, diff) @ v2[:m]

        def covariance(x1, x2, diff1, diff2):
            k2 = self.covariance(x2, y, diff2, ddiff)
            a, b = solver.solve(k2.T, wide(x2, diff2).T)
            return self.covariance(x1, x2, diff1, diff2) - self.covariance(x1, y, diff1, ddiff) @ a - wide(x1, diff1) @ b

        def variance(x, diff):
            k = self.covariance(x, y, diff, ddiff)
            a, b = solver.solve(k.T, wide(x, diff).T)
            return self.variance(x, diff) - (k * a.T).sum(1) - (wide(x, diff) * b.T).sum(1)

        return GaussianProcess(mean, covariance, None, variance, self.dim or y.shape[1])

    def __call__(self, x, chunk_size: int = 100):
        """(mean, standard deviation)."""
        x = self._at(x)
        parts = [x[i : i + chunk_size] for i in range(0, len(x), chunk_size)]
        return np.concatenate([self.mean(p) for p in parts]), np.concatenate([np.sqrt(np.maximum(self.variance(p), 0)) for p in parts])

    def log_likelihood(self, y, d, dcov=None, dvecs=None) -> float:
        y = self._at(y)
        extra = np.zeros((len(y), 0)) if dvecs is None else np.asarray(dvecs, float)
        return log_likelihood(d, self.mean(y), self.covariance(y, y) + _noise(dcov, len(y)), np.hstack([self.basis(y), extra]))

    def sample(self, x, use_cholesky: bool = False, count: int | None = None, seed: int = 0, c=None):
        """Draws at x; c: coefficients of the basis."""
        extra = 0 if c is None else self.basis(x) @ np.asarray(c, float)
        return sample(self.mean(x) + extra, self.covariance(x, x), use_cholesky, count, seed)

    def outliers(self, y, d, dsigma, tol: float = 4.0, maxitr: int = 50):
        y = self._at(y)
        return outliers(d, dsigma, self.mean(y), self.covariance(y, y), self.basis(y), tol, maxitr)

    def memoize(self) -> GaussianProcess:
        """The same process, remembering what its functions last gave."""
        return GaussianProcess(*(f and Memoize(f) for f in (self._mean, self._cov, self._basis, self._var)), dim=self.dim)

    def is_positive_definite(self, x) -> bool:
        return is_positive_definite(self.covariance(x, x))

    def score(self, points: DataFrame, diff=None) -> DataFrame:
        """(id, mean, sd) of a table of points; the process goes to every executor."""
        from pyspark import cloudpickle

        x = coordinates(points)
        shared = points.sparkSession.sparkContext.broadcast(cloudpickle.dumps(self if diff is None else self.differentiate(diff)))

        def run(batches):
            gp = cloudpickle.loads(shared.value)
            for rows in batches:
                if len(rows):
                    mean, sd = gp(rows[x].to_numpy(float))
                    yield pd.DataFrame({"id": rows["id"].to_numpy(), "mean": mean, "sd": sd})

        return points.select("id", *x).mapInPandas(run, "id bigint, mean double, sd double")


def _noise(dcov, n: int) -> np.ndarray:
    if dcov is None:
        return np.zeros((n, n))
    dcov = np.asarray(dcov, float)
    return np.diag(np.broadcast_to(dcov, n) ** 2) if dcov.ndim < 2 else dcov


def log_likelihood(d, mu, cov, vecs=None) -> float:
    """Of d under a normal distribution, restricted to what vecs can't explain."""
    d = np.asarray(d, float) - mu
    vecs = np.zeros((len(d), 0)) if vecs is None else np.asarray(vecs, float)
    n, m = vecs.shape
    solver = PartitionedPosDefSolver(cov, vecs)
    a, _ = solver.solve(d)
    out = -0.5 * (solver.a.log_det() + float(d @ a) + (n - m) * math.log(2 * math.pi))
    if m:
        out += 0.5 * (np.linalg.slogdet(vecs.T @ vecs)[1] - solver.schur.log_det())
    return float(out)


def sample(mu, cov, use_cholesky: bool = False, count: int | None = None, seed: int = 0):
    rng = np.random.default_rng(seed)
    if use_cholesky:
        root = np.linalg.cholesky(cov)
    else:
        value, vector = np.linalg.eigh(cov)
        root = vector[:, value > 0] * np.sqrt(value[value > 0])
    draws = np.asarray(mu) + rng.standard_normal((count or 1, root.shape[1])) @ root.T
    return draws if count is not None else draws[0]


def outliers(d, dsigma, mu, cov, vecs=None, tol: float = 4.0, maxitr: int = 50) -> np.ndarray:
    """Which data lie tol or more root mean square residuals off a fit to the others, found by refitting; a perfect fit has none."""
    d, s = np.asarray(d, float), np.broadcast_to(np.asarray(dsigma, float), np.shape(d))
    vecs = np.zeros((len(d), 0)) if vecs is None else np.asarray(vecs, float)
    good = np.ones(len(d), bool)
    for _ in range(maxitr):
        solver = PartitionedPosDefSolver(cov[np.ix_(good, good)] + np.diag(s[good] ** 2), vecs[good])
        a, b = solver.solve(d[good] - np.asarray(mu)[good])
        residual = np.abs(d - mu - cov[:, good] @ a - vecs @ b) / s
        rms = math.sqrt((residual[good] ** 2).mean())
        new = residual < tol * rms if rms > 0 else np.ones(len(d), bool)
        if (new == good).all():
            break
        good = new
    return ~good


def gpiso(phi, eps: float = 1.0, var: float = 1.0, dim: int | None = None, mean: float = 0.0) -> GaussianProcess:
    """Isotropic: covariance var * phi."""
    k = get_kernel(phi) if isinstance(phi, str) else phi

    def covariance(x1, x2, d1, d2):
        return var * (-1) ** sum(d2) * k.array(x1, x2, eps, tuple(a + b for a, b in zip(d1, d2, strict=True)))

    def variance(x, d):
        return np.full(len(x), covariance(x[:1], x[:1], d, d)[0, 0] if len(x) else 0.0)

    constant = (lambda x, d: np.full(len(x), 0.0 if sum(d) else mean)) if mean else None
    return GaussianProcess(constant, covariance, None, variance, dim)


def gpse(params, dim=None) -> GaussianProcess:
    return gpiso("se", params[2], params[1], dim, params[0])


def gpexp(params, dim=None) -> GaussianProcess:
    return gpiso("exp", params[2], params[1], dim, params[0])


def gppoly(order: int, dim: int | None = None) -> GaussianProcess:
    return GaussianProcess(basis=lambda x, d: monomials(x, order, d), dim=dim)


def gpbasis(basis, dim: int | None = None, delta: float = 1e-4) -> GaussianProcess:
    """Functions without priors on their coefficients; basis(x), made differentiable by differences."""
    f = differentiator(delta)(basis)
    return GaussianProcess(basis=lambda x, d: f(x, d), dim=dim)


def gpgibbs(lengthscale, sigma: float, delta: float = 1e-4) -> GaussianProcess:
    """A squared exponential whose length scales lengthscale(x) (n, d) change from place to place."""

    @covariance_differentiator(delta)
    def covariance(x1, x2):
        a, b = lengthscale(x1)[:, None, :] ** 2, lengthscale(x2)[None, :, :] ** 2
        d2 = (x1[:, None, :] - x2[None, :, :]) ** 2
        return sigma**2 * np.prod(np.sqrt(2 * np.sqrt(a * b) / (a + b)), -1) * np.exp(-(d2 / (a + b)).sum(-1))

    return GaussianProcess(covariance=covariance)


def score_groups(observations: DataFrame, points: DataFrame, group: str, make, value: str = "d", sigma: float = 0.0, most: int = MOST) -> DataFrame:
    """(group, id, mean, sd): one process make() for each group, conditioned on the group's own observations (at most so many)."""
    x = coordinates(observations)

    def run(obs: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(obs) or not len(at):
            return pd.DataFrame({group: [], "id": [], "mean": [], "sd": []})
        if len(obs) > most:
            raise ValueError(f"a group of {len(obs)} observations; at most {most}")
        obs = obs.sort_values("id")
        gp = make().condition(obs[x].to_numpy(float), obs[value].to_numpy(float), np.full(len(obs), sigma))
        mean, sd = gp(at[x].to_numpy(float))
        return pd.DataFrame({group: obs[group].iloc[0], "id": at["id"].to_numpy(), "mean": mean, "sd": sd})

    kind = f"`{group}` {observations.schema[group].dataType.simpleString()}, id bigint, mean double, sd double"
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  both may come from one table
    return fresh(observations).groupBy(group).cogroup(fresh(points).groupBy(group)).applyInPandas(run, kind)


def prior_covariance(a: DataFrame, b: DataFrame, phi, eps: float, var: float, diff1=None, diff2=None) -> DataFrame:
    """(i, j, value): the prior covariance as a column expression."""
    from pointloom.operators.pairs import all_pairs

    z = _zero(len(coordinates(a)))
    d1, d2 = tuple(diff1 or z), tuple(diff2 or z)
    out = all_pairs(a, b, phi, eps, tuple(p + q for p, q in zip(d1, d2, strict=True)))
    return out.select("i", "j", (F.col("value") * F.lit(float(var) * (-1) ** sum(d2))).alias("value"))


def gibbs_covariance(a: DataFrame, b: DataFrame, lengthscale, sigma: float) -> DataFrame:
    """(i, j, value): gpgibbs as a column expression; lengthscale(column) gives a coordinate's length scale."""
    from pointloom.operators.pairs import all_pairs_of

    value = F.lit(float(sigma) ** 2)
    x = coordinates(a)
    for c in x:
        p, q = lengthscale(F.col("a" + c)), lengthscale(F.col("b" + c))
        gap, both = F.col("a" + c) - F.col("b" + c), p * p + q * q
        value = value * F.sqrt(2 * p * q / both) * F.exp(-gap * gap / both)
    return all_pairs_of(a, b).select("i", "j", value.alias("value"))


def diagonal_log_likelihood(points: DataFrame, d, mu, var) -> DataFrame:
    """(value): log likelihood of column d under independent normal distributions; one sum over all rows."""
    return points.agg(F.sum(-0.5 * ((d - mu) * (d - mu) / var + F.log(var) + math.log(2 * math.pi))).alias("value"))


def constant_outliers(points: DataFrame, value: str, tol: float = 4.0, maxitr: int = 50) -> DataFrame:
    """(id, outlier): outliers() for a process that is an unknown constant with equal noise; each refit is two sums over all rows."""
    mean = rms = None
    for _ in range(maxitr):
        good = points if mean is None else points.where(F.abs(F.col(value) - mean) < tol * rms)
        r = good.agg(F.avg(value).alias("m"), F.count(value).alias("n")).first()
        if not r.n:
            break
        spread = good.agg(F.avg((F.col(value) - r.m) ** 2).alias("v")).first().v
        new = (r.m, math.sqrt(spread))
        if new == (mean, rms):
            break
        mean, rms = new
    far = F.abs(F.col(value) - mean) >= tol * rms if mean is not None and rms > 0 else F.lit(False)
    return points.select("id", far.alias("outlier"))

"""Radial kernels with exact Cartesian derivatives of any order, as columns and as numpy arrays.

A kernel is a profile of rho = eps * r or r / eps: a sum of terms coefficient * rho^power * log(rho)^{0,1} times one of 1, exp(-s rho),
exp(-s rho^2), or a power of 1 + rho^2. The operator (1/rho) d/drho maps each family to itself, so psi_k, which it gives applied k
times, is a table of numbers computed when a plan is built. Cartesian derivatives are combinations of coordinates and psi_k.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (power of rho, power of log rho) -> coefficient.
Terms = dict[tuple[int, int], float]


def _poly(*coefficients: float) -> Terms:
    """Terms of a polynomial, constant first."""
    return {(i, 0): float(c) for i, c in enumerate(coefficients) if c}


def _times(a: list[float], b: list[float]) -> list[float]:
    return np.convolve(a, b).tolist()


def _power(base: list[float], n: int) -> list[float]:
    out = [1.0]
    for _ in range(n):
        out = _times(out, base)
    return out


@dataclass(frozen=True)
class Kernel:
    """name, terms, family ("pow", "exp", "gauss", "bin"), its constant, order of conditional definiteness, whether eps divides r.

    tol and supp are multiples of eps (None: no such region). sparse: only pairs within the support are ever formed.
    """

    name: str
    terms: tuple = field(hash=False)
    family: str = "pow"
    rate: float = 0.0
    cpd_order: int = 0
    divides: bool = False
    tol: float | None = None
    supp: float | None = None
    sparse: bool = False

    def psi(self, k: int) -> Terms:
        """Terms of psi_k in rho; for family "bin" the power of 1 + rho^2 is rate - k."""
        terms = dict(self.terms)
        for step in range(k):
            new: Terms = {}

            def put(key, c, new=new):
                if c:
                    new[key] = new.get(key, 0.0) + c

            for (a, b), c in terms.items():
                if self.family == "bin":
                    put((a, b), 2 * (self.rate - step) * c)
                    continue
                put((a - 2, b), c * a)
                if b:
                    put((a - 2, 0), c)
                if self.family == "exp":
                    put((a - 1, b), -self.rate * c)
                elif self.family == "gauss":
                    put((a, b), -2 * self.rate * c)
            terms = {key: c for key, c in new.items() if abs(c) > 0}
        return terms

    def _scale(self, eps, k: int):
        return eps ** (-2 * k) if self.divides else eps ** (2 * k)

    def _rho(self, r, eps):
        return r / eps if self.divides else r * eps

    def psi_column(self, k: int, r: Column, eps: Column) -> Column:
        rho = self._rho(r, eps)
        total = None
        for (a, b), c in sorted(self.psi(k).items()):
            t = F.lit(c)
            if a:
                t = t * _int_power(rho, a)
            if b:
                t = t * F.log(rho)
            total = t if total is None else total + t
        total = F.lit(0.0) if total is None else total
        if self.family == "exp":
            total = total * F.exp(-self.rate * rho)
        elif self.family == "gauss":
            total = total * F.exp(-self.rate * rho * rho)
        elif self.family == "bin":
            total = total * _half_power(1 + rho * rho, self.rate - k)
        if not k:
            return total
        scale = F.pow(eps, F.lit(-2.0 * k if self.divides else 2.0 * k))
        return total * scale

    def psi_array(self, k: int, r: np.ndarray, eps) -> np.ndarray:
        rho = self._rho(r, eps)
        total = np.zeros(np.broadcast(r, eps).shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            for (a, b), c in self.psi(k).items():
                total = total + c * rho ** float(a) * (np.log(rho) if b else 1.0)
            if self.family == "exp":
                total = total * np.exp(-self.rate * rho)
            elif self.family == "gauss":
                total = total * np.exp(-self.rate * rho * rho)
            elif self.family == "bin":
                total = total * (1 + rho * rho) ** (self.rate - k)
        return total * self._scale(np.asarray(eps, float), k)

    def center_value(self, diff: tuple[int, ...], eps: float = 1.0) -> float:
        """The limit at the center along the first axis, from above; infinite where it diverges, NaN where the kernel names no limit."""
        total_order = sum(diff)
        if self.name == "exp" and total_order:
            return math.nan
        if any(a % 2 for a in diff[1:]):
            return 0.0
        series: dict[tuple[int, int], float] = {}
        for coef, powers, k in _combination(tuple(diff)):
            if any(powers[1:]):
                continue
            for (a, b), c in self.psi(k).items():
                expand = [(0, 1.0)]
                if self.family == "exp":
                    expand = [(j, (-self.rate) ** j / math.factorial(j)) for j in range(2 * total_order + 2)]
                elif self.family == "gauss":
                    expand = [(2 * j, (-self.rate) ** j / math.factorial(j)) for j in range(total_order + 2)]
                for j, e in expand:
                    key = (a + powers[0] + j, b)
                    series[key] = series.get(key, 0.0) + coef * c * e
        series = {key: v for key, v in series.items() if abs(v) > 1e-9}
        low = min(series, key=lambda key: (key[0], -key[1]), default=(0, 0))
        if low[0] < 0 or low == (0, 1):
            return math.copysign(math.inf, series[low] * (-1 if low[1] else 1))
        value = series.get((0, 0), 0.0)
        return value * eps ** (-total_order if self.divides else total_order)

    def column(self, d: list[Column], eps: Column | float = 1.0, diff: tuple[int, ...] | None = None) -> Column:
        """The kernel or its derivative for differences d = x - center; eps may differ by row."""
        diff = tuple(diff or (0,) * len(d))
        varying = isinstance(eps, Column)
        e = eps if varying else F.lit(float(eps))
        r2 = None
        for x in d:
            r2 = x * x if r2 is None else r2 + x * x
        r = F.sqrt(r2) if len(d) > 1 else F.abs(d[0])
        value = None
        for coef, powers, k in _combination(diff):
            t = self.psi_column(k, r, e)
            if coef != 1:
                t = F.lit(float(coef)) * t
            for x, p in zip(d, powers, strict=True):
                for _ in range(p):
                    t = t * x
            value = t if value is None else value + t
        if self.supp is not None:
            value = F.when(r <= self.supp * e, value).otherwise(F.lit(0.0))
        if self.tol is not None:
            order = sum(diff)
            at = self.center_value(diff, 1.0)
            limit = F.lit(at) if not order else F.lit(at) * F.pow(e, F.lit(float(-order if self.divides else order)))
            value = F.when(r <= self.tol * e, limit).otherwise(value)
        return value

    def array(self, x: np.ndarray, c: np.ndarray, eps=1.0, diff: tuple[int, ...] | None = None) -> np.ndarray:
        """(..., N, M) values for x (..., N, D) and centers c (..., M, D); eps scalar or (..., M)."""
        x, c = np.asarray(x, float), np.asarray(c, float)
        gap = lambda i: x[..., :, None, i] - c[..., None, :, i]  # noqa: E731  one axis at a time: all at once take D times the memory
        diff = tuple(diff or (0,) * x.shape[-1])
        e = np.asarray(eps, float)
        e = e[..., None, :] if e.ndim else e
        r = np.sqrt(sum((gap(i) ** 2 for i in range(1, x.shape[-1])), gap(0) ** 2))
        value = np.zeros(r.shape)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for coef, powers, k in _combination(diff):
                t = coef * self.psi_array(k, r, e)
                for i, p in enumerate(powers):
                    if p:
                        t = t * gap(i) ** p
                value = value + t
        if self.supp is not None:
            value = np.where(r <= self.supp * e, value, 0.0)
        if self.tol is not None:
            order = sum(diff)
            limit = self.center_value(diff, 1.0) * (e ** (-order if self.divides else order))
            value = np.where(r <= self.tol * e, limit, value)
        return value


def _int_power(x: Column, n: int) -> Column:
    out = x
    for _ in range(abs(n) - 1):
        out = out * x
    return F.lit(1.0) / F.nullif(out, F.lit(0.0)) if n < 0 else out  # null at the center, where the kernel names no limit


def _half_power(x: Column, p: float) -> Column:
    """x, at least 1, to a multiple of a half: Spark's pow takes several times as long as a root and products."""
    factors = [x] * int(abs(p)) + [F.sqrt(x)] * (2 * p % 2 == 1)
    out = F.lit(1.0)
    for f in factors:
        out = out * f
    return F.lit(1.0) / out if p < 0 else out


@lru_cache(1000)
def _combination(diff: tuple[int, ...]) -> list[tuple[int, tuple[int, ...], int]]:
    """(coefficient, powers of the coordinates, index of psi) whose sum is the derivative."""
    out = []
    for m in itertools.product(*(range(a // 2 + 1) for a in diff)):
        coef = math.prod(math.factorial(a) // (math.factorial(i) * math.factorial(a - 2 * i) * 2**i) for a, i in zip(diff, m, strict=True))
        out.append((coef, tuple(a - 2 * i for a, i in zip(diff, m, strict=True)), sum(diff) - sum(m)))
    return out


def _phs(n: int) -> Kernel:
    even, order = n % 2 == 0, n // 2 + 1
    sign = (-1) ** (n // 2 + 1) if even else (-1) ** ((n + 1) // 2)
    return Kernel(f"phs{n}", ((((n, int(even)), float(sign))),), cpd_order=order, tol=0.0)


def _wendland(name: str, cut: int, factor: list[float], sparse: bool) -> Kernel:
    terms = _poly(*_times(_power([1.0, -1.0], cut), factor))
    return Kernel(("sp" if sparse else "") + name, tuple(terms.items()), divides=True, tol=1e-8, supp=1.0, sparse=sparse)


def _register() -> dict[str, Kernel]:
    s3, s5 = math.sqrt(3), math.sqrt(5)
    one = (((0, 0), 1.0),)
    found = [_phs(n) for n in range(1, 9)]
    found += [
        Kernel("mq", (((0, 0), -1.0),), "bin", 0.5, cpd_order=1),
        Kernel("imq", one, "bin", -0.5),
        Kernel("iq", one, "bin", -1.0),
        Kernel("ga", one, "gauss", 1.0),
        Kernel("exp", one, "exp", 1.0, divides=True),
        Kernel("se", one, "gauss", 0.5, divides=True),
        Kernel("mat32", tuple(_poly(1, s3).items()), "exp", s3, divides=True, tol=1e-8),
        Kernel("mat52", tuple(_poly(1, s5, 5 / 3).items()), "exp", s5, divides=True, tol=1e-4),
    ]
    # Powers of (1 - q) and polynomial factors of the compact kernels.
    compact = {"wen10": (1, [1.0]), "wen11": (3, [1.0, 3.0]), "wen12": (5, [1.0, 5.0, 8.0]), "wen30": (2, [1.0]), "wen31": (4, [1.0, 4.0]), "wen32": (6, [1.0, 6.0, 35 / 3])}
    for sparse in (False, True):
        found += [_wendland(n, cut, f, sparse) for n, (cut, f) in compact.items()]
    return {k.name: k for k in found}


KERNELS = _register()


def get_kernel(kernel: str | Kernel) -> Kernel:
    """A kernel by name; kernels pass through."""
    if isinstance(kernel, Kernel):
        return kernel
    if kernel not in KERNELS:
        raise ValueError(f"no kernel {kernel!r}; there are {', '.join(KERNELS)}")
    return KERNELS[kernel]


class CustomKernel:
    """A kernel from the user's own profiles: psi[k](r, eps), for columns and for arrays (functions that take either).

    Where psi[k] is missing, derivatives use forward differences of width delta.
    """

    def __init__(self, psi, name: str = "custom", cpd_order: int = 0, tol: float | None = None, supp: float | None = None, delta: float = 1e-4):
        self.functions, self.name, self.cpd_order, self.tol, self.supp, self.delta = list(psi), name, cpd_order, tol, supp, delta
        self.divides, self.sparse = False, False

    def array(self, x, c, eps=1.0, diff=None):
        x, c = np.asarray(x, float), np.asarray(c, float)
        diff = tuple(diff or (0,) * x.shape[-1])
        if sum(diff) >= len(self.functions):
            i = next(i for i, a in enumerate(diff) if a)
            lower = tuple(a - (j == i) for j, a in enumerate(diff))
            step = np.zeros(x.shape[-1])
            step[i] = self.delta
            return (self.array(x + step, c, eps, lower) - self.array(x, c, eps, lower)) / self.delta
        d = x[..., :, None, :] - c[..., None, :, :]
        r = np.sqrt((d * d).sum(-1))
        value = sum(coef * self.functions[k](r, eps) * np.prod(d ** np.array(powers), axis=-1) for coef, powers, k in _combination(diff))
        return value if self.supp is None else np.where(r <= self.supp, value, 0.0)

    def column(self, d, eps=1.0, diff=None):
        diff = tuple(diff or (0,) * len(d))
        e = eps if isinstance(eps, Column) else F.lit(float(eps))
        if sum(diff) >= len(self.functions):
            i = next(i for i, a in enumerate(diff) if a)
            lower = tuple(a - (j == i) for j, a in enumerate(diff))
            moved = [x + self.delta if j == i else x for j, x in enumerate(d)]
            return (self.column(moved, e, lower) - self.column(d, e, lower)) / self.delta
        r = F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))
        value = F.lit(0.0)
        for coef, powers, k in _combination(diff):
            t = coef * self.functions[k](r, e)
            for x, p in zip(d, powers, strict=True):
                for _ in range(p):
                    t = t * x
            value = value + t
        return value if self.supp is None else F.when(r <= self.supp, value).otherwise(0.0)

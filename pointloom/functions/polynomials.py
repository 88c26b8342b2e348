"""Monomials and their derivatives: powers are planned on the driver, values are columns or arrays."""

import itertools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def monomial_powers(degree: int, ndim: int) -> list[tuple[int, ...]]:
    """Powers of all monomials up to a degree, by degree; none for degree -1."""
    out = []
    for total in range(degree + 1):
        for chosen in itertools.combinations_with_replacement(range(ndim), total):
            out.append(tuple(chosen.count(i) for i in range(ndim)))
    return out


def monomial_count(degree: int, ndim: int) -> int:
    return math.comb(degree + ndim, ndim) if degree >= 0 else 0


def max_degree(size: int, ndim: int) -> int:
    """The largest degree with at most size monomials; -1 if there is none."""
    degree = -1
    while monomial_count(degree + 1, ndim) <= size:
        degree += 1
    return degree


def _differentiated(powers, diff):
    """(factor, powers) of the derivative of a monomial."""
    factor = math.prod(math.perm(p, d) for p, d in zip(powers, diff, strict=True))
    return factor, tuple(max(p - d, 0) if factor else 0 for p, d in zip(powers, diff, strict=True))


def monomial_columns(x: list[Column], degree: int | list[tuple[int, ...]], diff: tuple[int, ...] | None = None) -> list[Column]:
    """A column for each monomial or its derivative."""
    out = []
    for powers in monomial_powers(degree, len(x)) if isinstance(degree, int) else degree:
        factor, left = _differentiated(powers, diff or (0,) * len(x))
        value = F.lit(float(factor))
        for c, p in zip(x, left, strict=True):
            for _ in range(p):
                value = value * c
        out.append(value)
    return out


def monomials(x: np.ndarray, degree: int | list[tuple[int, ...]], diff: tuple[int, ...] | None = None) -> np.ndarray:
    """(..., N, P) values for x (..., N, D)."""
    x = np.asarray(x, float)
    ndim = x.shape[-1]
    powers = monomial_powers(degree, ndim) if isinstance(degree, int) else degree
    out = np.empty((*x.shape[:-1], len(powers)))
    for j, p in enumerate(powers):
        factor, left = _differentiated(p, diff or (0,) * ndim)
        out[..., j] = factor * np.prod(x ** np.array(left), axis=-1)
    return out

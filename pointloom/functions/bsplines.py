"""B-spline bases by the recursion over orders, as columns and arrays."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def augmented_knots(low: float, high: float, inner: int, order: int) -> list[float]:
    """Equally spaced knots with both ends repeated order times more."""
    middle = np.linspace(low, high, inner + 2).tolist()
    return [low] * order + middle + [high] * order


def natural_knots(count: int, order: int, side: str = "both") -> list[float]:
    """Knots on [0, 1] for count bases, with the ends that side names (both, left, right, none) repeated order times more."""
    if side not in ("both", "left", "right", "none"):
        raise ValueError(f"side is both, left, right or none, not {side!r}")
    ends = {"both": 2, "left": 1, "right": 1, "none": 0}[side]
    inner = np.linspace(0, 1, count + 1 + (1 - ends) * order).tolist()
    return [0.0] * (order if side in ("both", "left") else 0) + inner + [1.0] * (order if side in ("both", "right") else 0)


def is_sorted(knots) -> bool:
    return bool((np.diff(np.asarray(knots, float)) >= 0).all())


def basis_number(knots, order: int) -> int:
    return len(knots) - order - 1


def bspline_array(x, knots, index: int, order: int, diff: int = 0) -> np.ndarray:
    x = np.asarray(x, float)
    if diff:
        a, b = knots[index + order] - knots[index], knots[index + order + 1] - knots[index + 1]
        left = order / a * bspline_array(x, knots, index, order - 1, diff - 1) if a else 0.0 * x
        right = order / b * bspline_array(x, knots, index + 1, order - 1, diff - 1) if b else 0.0 * x
        return left - right
    if order == 0:
        return ((x >= knots[index]) & (x < knots[index + 1])).astype(float)
    a, b = knots[index + order] - knots[index], knots[index + order + 1] - knots[index + 1]
    left = (x - knots[index]) / a * bspline_array(x, knots, index, order - 1) if a else 0.0 * x
    right = (knots[index + order + 1] - x) / b * bspline_array(x, knots, index + 1, order - 1) if b else 0.0 * x
    return left + right


def bspline(x: Column, knots, index: int, order: int, diff: int = 0) -> Column:
    a, b = knots[index + order] - knots[index], knots[index + order + 1] - knots[index + 1]
    zero = F.lit(0.0)
    if diff:
        left = F.lit(order / a) * bspline(x, knots, index, order - 1, diff - 1) if a else zero
        right = F.lit(order / b) * bspline(x, knots, index + 1, order - 1, diff - 1) if b else zero
        return left - right
    if order == 0:
        return F.when((x >= knots[index]) & (x < knots[index + 1]), 1.0).otherwise(0.0)
    left = (x - knots[index]) / a * bspline(x, knots, index, order - 1) if a else zero
    right = (knots[index + order + 1] - x) / b * bspline(x, knots, index + 1, order - 1) if b else zero
    return left + right


def bspline_nd(x: list[Column], knots: list, index: tuple[int, ...], order: tuple[int, ...], diff: tuple[int, ...] | None = None) -> Column:
    out = F.lit(1.0)
    for c, k, i, o, d in zip(x, knots, index, order, diff or (0,) * len(x), strict=True):
        out = out * bspline(c, k, i, o, d)
    return out

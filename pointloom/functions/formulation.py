"""Differential operators as sums of terms: a small algebra instead of symbols."""

from __future__ import annotations

from pyspark.sql import Column


class Operator:
    """Terms derivative -> coefficient, a number or a column of the points that the operator is taken at."""

    def __init__(self, terms: dict[tuple[int, ...], float | Column]):
        self.terms = {d: c for d, c in terms.items() if isinstance(c, Column) or c}

    @classmethod
    def derivative(cls, *diff: int) -> Operator:
        return cls({tuple(diff): 1.0})

    @classmethod
    def laplacian(cls, dim: int) -> Operator:
        return cls({tuple(2 * (k == i) for k in range(dim)): 1.0 for i in range(dim)})

    def __add__(self, other: Operator) -> Operator:
        out = dict(self.terms)
        for d, c in other.terms.items():
            out[d] = out[d] + c if d in out else c
        return Operator(out)

    def __mul__(self, factor: float | Column | Operator) -> Operator:
        """Times a number or column, or applied to what another operator gives, whose coefficients must then be numbers."""
        if not isinstance(factor, Operator):
            return Operator({d: c * factor for d, c in self.terms.items()})
        if any(isinstance(c, Column) for c in factor.terms.values()) and any(map(sum, self.terms)):
            raise ValueError("coefficients that vary can't be differentiated here")
        out: dict[tuple[int, ...], float | Column] = {}
        for d, c in self.terms.items():
            for e, f in factor.terms.items():
                key = tuple(a + b for a, b in zip(d, e, strict=True))
                out[key] = out[key] + c * f if key in out else c * f
        return Operator(out)

    __rmul__ = __mul__

    def __sub__(self, other: Operator) -> Operator:
        return self + other * -1.0

    def parts(self) -> tuple[list, list[tuple[int, ...]]]:
        """(coefficients, derivatives), as weight matrices take them."""
        return list(self.terms.values()), list(self.terms)

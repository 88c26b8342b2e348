"""Kernels given as text, with exact derivatives: expressions of r and eps are parsed, differentiated by rule and planned as columns or arrays."""

from __future__ import annotations

import ast
import math

import numpy as np
from pyspark.sql import functions as F

from pointloom.functions.kernels import CustomKernel

#: An expression is a number, a name, or (operation, operands..).
UNARY = ("exp", "log", "sqrt", "sin", "cos", "tanh")
_OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}


def parse(text: str):
    """The expression of a text; ValueError for other names than r, eps, pi and e, or other functions."""

    def walk(n):
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return float(n.value)
        if isinstance(n, ast.Name):
            if n.id in ("pi", "e"):
                return getattr(math, n.id)
            if n.id in ("r", "eps"):
                return n.id
            raise ValueError(f"{n.id!r} is neither r nor eps")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return times(-1.0, walk(n.operand)) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp) and type(n.op) in _OPERATORS:
            a, b = walk(n.left), walk(n.right)
            return {"+": plus, "-": lambda x, y: plus(x, times(-1.0, y)), "*": times, "/": over, "**": power}[_OPERATORS[type(n.op)]](a, b)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in UNARY and len(n.args) == 1 and not n.keywords:
            return (n.func.id, walk(n.args[0]))
        raise ValueError(f"not an expression of r and eps: {ast.unparse(n)}")

    try:
        return walk(ast.parse(text, mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e


def plus(a, b):
    if a == 0.0 or b == 0.0:
        return b if a == 0.0 else a
    return a + b if isinstance(a, float) and isinstance(b, float) else ("+", a, b)


def times(a, b):
    if a == 0.0 or b == 0.0:
        return 0.0
    if a == 1.0 or b == 1.0:
        return b if a == 1.0 else a
    if isinstance(b, float):
        a, b = b, a
    if isinstance(a, float) and isinstance(b, float):
        return a * b
    if isinstance(a, float) and isinstance(b, tuple) and b[0] == "*" and isinstance(b[1], float):
        return times(a * b[1], b[2])
    return ("*", a, b)


def power(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a**b
    if not isinstance(b, float):
        return ("exp", times(b, ("log", a)))
    if b in (0.0, 1.0):
        return 1.0 if b == 0.0 else a
    if isinstance(a, tuple) and a[0] == "**" and a[2] == int(a[2]) and b == int(b):
        return power(a[1], a[2] * b)
    return ("**", a, b)


def over(a, b):
    return times(a, power(b, -1.0))


def names(e) -> set[str]:
    return {e} if isinstance(e, str) else set().union(*map(names, e[1:])) if isinstance(e, tuple) else set()


def replaced(e, name: str, by):
    if e == name:
        return by
    return (e[0], *(replaced(x, name, by) for x in e[1:])) if isinstance(e, tuple) else e


def derivative(e):
    """d e / d r."""
    if not isinstance(e, tuple):
        return 1.0 if e == "r" else 0.0
    kind, a = e[0], e[1]
    d = derivative(a)
    if kind == "+":
        return plus(d, derivative(e[2]))
    if kind == "*":
        return plus(times(d, e[2]), times(a, derivative(e[2])))
    if kind == "**":
        return times(times(e[2], power(a, e[2] - 1)), d)
    slope = {
        "exp": lambda: e,
        "log": lambda: power(a, -1.0),
        "sqrt": lambda: times(0.5, power(e, -1.0)),
        "sin": lambda: ("cos", a),
        "cos": lambda: times(-1.0, ("sin", a)),
        "tanh": lambda: plus(1.0, times(-1.0, power(e, 2.0))),
    }[kind]()
    return times(slope, d)


def value(e, r, eps, columns: bool):
    """e for columns or arrays r and eps."""
    if isinstance(e, float):
        return F.lit(e) if columns else e
    if isinstance(e, str):
        return r if e == "r" else eps
    a = value(e[1], r, eps, columns)
    if e[0] in ("+", "*"):
        b = value(e[2], r, eps, columns)
        return a + b if e[0] == "+" else a * b
    if e[0] == "**":
        return _power(a, e[2], columns)
    return getattr(F if columns else np, e[0])(a)


def _power(a, n: float, columns: bool):
    if n != int(n) or abs(n) > 8:
        return F.pow(a, F.lit(n)) if columns else np.power(a, n)
    out = a
    for _ in range(abs(int(n)) - 1):
        out = out * a
    if n > 0:
        return out
    return F.lit(1.0) / F.nullif(out, F.lit(0.0)) if columns else 1.0 / out


class ExpressionKernel(CustomKernel):
    """A kernel from a text such as "exp(-(eps*r)**2)": derivatives of any order are exact.

    A text without eps takes eps * r for r. At pairs no farther than tol apart the value is that of limits, {derivative: text of eps}, or
    where it names none, that at distance tol along the first axis; without tol, a derivative at the center is null (NaN in arrays)
    where the formula divides by zero. Beyond supp the kernel is 0.
    """

    def __init__(self, text: str, name: str = "expression", cpd_order: int = 0, tol: float | None = None, supp: float | None = None, limits: dict[tuple[int, ...], str] | None = None, sparse: bool = False):
        e = parse(text)
        if "r" not in names(e):
            raise ValueError("a kernel depends on r")
        if sparse and supp is None:
            raise ValueError("a sparse kernel needs supp")
        super().__init__([], name, cpd_order, tol, supp)
        self.psi = [e if "eps" in names(e) else replaced(e, "r", ("*", "eps", "r"))]
        self.limits, self.sparse = {d: parse(t) for d, t in (limits or {}).items()}, sparse
        if any("r" in names(t) for t in self.limits.values()):
            raise ValueError("limits depend on eps only")

    def _profile(self, k: int):
        while len(self.psi) <= k:
            self.psi.append(times(derivative(self.psi[-1]), power("r", -1.0)))
        return self.psi[k]

    def _with_profiles(self, order: int):
        own = [self._profile(k) for k in range(order + 1)]
        plain = CustomKernel([], self.name, self.cpd_order, None, self.supp)
        return plain, own

    def array(self, x, c, eps=1.0, diff=None):
        x, c = np.asarray(x, float), np.asarray(c, float)
        diff = tuple(diff or (0,) * x.shape[-1])
        plain, own = self._with_profiles(sum(diff))
        plain.functions = [lambda r, e, p=p: value(p, r, e, False) + 0.0 * r for p in own]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            out = plain.array(x, c, eps, diff)
        if self.tol is not None:
            near = np.sqrt(((x[..., :, None, :] - c[..., None, :, :]) ** 2).sum(-1)) <= self.tol
            out = np.where(near, self._limit(diff, eps), out)
        return out

    def _limit(self, diff, eps):
        if diff in self.limits:
            return value(self.limits[diff], 0.0, eps, False)
        plain, own = self._with_profiles(sum(diff))
        plain.functions = [lambda r, e, p=p: value(p, r, e, False) + 0.0 * r for p in own]
        return plain.array(np.array([[self.tol] + [0.0] * (len(diff) - 1)]), np.zeros((1, len(diff))), eps, diff)[0, 0]

    def column(self, d, eps=1.0, diff=None):
        diff = tuple(diff or (0,) * len(d))
        plain, own = self._with_profiles(sum(diff))
        plain.functions = [lambda r, e, p=p: value(p, r, e, True) for p in own]
        out = plain.column(d, eps, diff)
        if self.tol is None:
            return out
        e = eps if not isinstance(eps, (int, float)) else F.lit(float(eps))
        at = value(self.limits[diff], None, e, True) if diff in self.limits else plain.column([F.lit(self.tol)] + [F.lit(0.0)] * (len(d) - 1), e, diff)
        r = F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))
        return F.when(r <= self.tol, at).otherwise(out)

"""Solvers: dense ones in numpy for systems that fit a task, iterative ones over (row, col, value) frames for those that don't."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import sparse


class Solver:
    """LU through numpy."""

    def __init__(self, a, build_inverse: bool = False, check_cond: bool = False):
        self.a = np.asarray(a, float)
        if check_cond and self.a.size and np.linalg.cond(self.a, 1) > 1 / np.finfo(float).eps:
            warnings.warn("the matrix is ill-conditioned", stacklevel=2)
        self.inverse = np.linalg.inv(self.a) if build_inverse else None

    def solve(self, b):
        return self.inverse @ b if self.inverse is not None else np.linalg.solve(self.a, b)


class PosDefSolver:
    """Cholesky; LinAlgError if the matrix isn't positive definite."""

    def __init__(self, a, build_inverse: bool = False):
        self.l_factor = np.linalg.cholesky(np.asarray(a, float))
        self.inverse = None
        if build_inverse:
            self.inverse = self.solve(np.eye(len(self.l_factor)))

    def L(self):  # noqa: N802
        return self.l_factor

    def solve_L(self, b):  # noqa: N802
        return np.linalg.solve(self.l_factor, b)

    def solve(self, b):
        if self.inverse is not None:
            return self.inverse @ b
        return np.linalg.solve(self.l_factor.T, np.linalg.solve(self.l_factor, b))

    def log_det(self) -> float:
        return 2 * float(np.log(np.diag(self.l_factor)).sum())


def is_positive_definite(a) -> bool:
    try:
        np.linalg.cholesky(np.asarray(a, float))
    except np.linalg.LinAlgError:
        return False
    return True


def _parts(a, b, n):
    return a if b is None else np.concatenate([a, b]), n


class PartitionedSolver:
    """[[A, B], [B', 0]] [x, y] = [a, b], whole by LU."""

    def __init__(self, a, b, build_inverse: bool = False, check_cond: bool = False):
        a, b = np.asarray(a, float), np.asarray(b, float)
        self.n, self.p = b.shape
        if self.n < self.p:
            raise np.linalg.LinAlgError("fewer rows than constraints")
        self.whole = Solver(np.block([[a, b], [b.T, np.zeros((self.p, self.p))]]), build_inverse, check_cond)

    def solve(self, a, b=None):
        a = np.asarray(a, float)
        b = np.zeros((self.p, *a.shape[1:])) if b is None else b
        out = self.whole.solve(np.concatenate([a, b]))
        return out[: self.n], out[self.n :]


class PartitionedPosDefSolver:
    """The same system by the Schur complement of a positive definite A."""

    def __init__(self, a, b, build_inverse: bool = False):
        b = np.asarray(b, float)
        self.n, self.p = b.shape
        if self.n < self.p:
            raise np.linalg.LinAlgError("fewer rows than constraints")
        self.a, self.b = PosDefSolver(a, build_inverse), b
        self.ab = self.a.solve(b)
        self.schur = PosDefSolver(b.T @ self.ab) if self.p else None

    def solve(self, a, b=None):
        x = self.a.solve(np.asarray(a, float))
        if not self.p:
            return x, np.zeros((0, *x.shape[1:]))
        y = self.schur.solve(self.b.T @ x - (0 if b is None else b))
        return x - self.ab @ y, y


def to_dense(a: DataFrame, rows: int, cols: int, most: int = 5000) -> np.ndarray:
    """A small matrix on the driver; ValueError for one that is larger than most by most."""
    if max(rows, cols) > most:
        raise ValueError(f"a matrix of {rows} by {cols} is too large to gather; use cg or gmres")
    out = np.zeros((rows, cols))
    for r in sparse.canonical(a).collect():
        out[r["row"], r["col"]] = r["value"]
    return out


def solve_gathered(a: DataFrame, b: DataFrame, most: int = 5000) -> DataFrame:
    """(row, x) of a square system with right side b (row, value), gathered if it has at most so many rows and 400 entries for each."""
    if a.limit(400 * most + 1).count() > 400 * most:
        raise ValueError("too many entries to gather; use cg or gmres")
    order = [r["row"] for r in b.orderBy("row").limit(most + 1).collect()]
    if len(order) > most:
        raise ValueError("too large to gather; use cg or gmres")
    at = {r: i for i, r in enumerate(order)}
    dense, right = np.zeros((len(order),) * 2), np.zeros(len(order))
    for r in sparse.canonical(a).collect():
        dense[at[r["row"]], at[r["col"]]] = r["value"]
    for r in b.collect():
        right[at[r["row"]]] += r["value"]
    x = np.linalg.solve(dense, right)
    return a.sparkSession.createDataFrame([(int(r), float(v)) for r, v in zip(order, x, strict=True)], "row long, x double")


def _kept(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or "/tmp/pointloom-checkpoints")
    return df.checkpoint()


def cg(a: DataFrame, b: DataFrame, tolerance: float = 1e-8, rounds: int = 500) -> DataFrame:
    """(row, x) for a symmetric positive definite a: conjugate gradients with a diagonal preconditioner.

    All vectors are columns of one frame; a round is one product and one checkpoint.
    """
    a = _kept(sparse.canonical(a))
    scale = a.where("row = col").select("row", F.col("value").alias("d"))
    state = b.groupBy("row").agg(F.sum("value").alias("r")).join(scale, "row").select("row", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("p"))
    state = _kept(state)
    rz, size = state.agg(F.sum(F.expr("r * r / d")), F.sum(F.expr("r * r"))).first()
    limit = tolerance**2 * (size or 0.0)
    for _ in range(rounds):
        if not size or size <= limit:
            break
        ap = sparse.matvec(a, state.select(F.col("row").alias("col"), F.col("p").alias("x"))).select("row", F.col("value").alias("ap"))
        state = _kept(state.join(ap, "row", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))))
        step = rz / state.agg(F.sum(F.expr("p * ap"))).first()[0]
        state = state.select("row", "d", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "p")
        new, size = state.agg(F.sum(F.expr("r * r / d")), F.sum(F.expr("r * r"))).first()
        state = state.select("row", "d", "x", "r", (F.col("r") / F.col("d") + new / rz * F.col("p")).alias("p"))
        rz = new
    return state.select("row", "x")


def gmres(a: DataFrame, b: DataFrame, tolerance: float = 1e-8, restart: int = 30, rounds: int = 10) -> DataFrame:
    """(row, x) of a general system: restarted GMRES on rows divided by their norms, with a diagonal preconditioner.

    The solution, the residual and the basis are columns of one frame; a step is one product, one checkpoint and two sums over all
    columns, as the new vector is made orthogonal to the basis twice.
    """
    a = sparse.canonical(a)
    norms = sparse.row_norms(a).select("row", F.col("norm").alias("x"))
    a = _kept(sparse.divide_rows(a, norms))
    scale = a.where("row = col and value <> 0").select("row", F.col("value").alias("d"))
    right = b.groupBy("row").agg(F.sum("value").alias("value")).join(norms, "row").join(scale, "row", "left")
    state = _kept(right.select("row", F.coalesce("d", F.lit(1.0)).alias("d"), F.lit(0.0).alias("x"), (F.col("value") / F.col("x")).alias("b")))
    total = lambda df, *sums: [v or 0.0 for v in df.agg(*(F.sum(c) for c in sums)).first()]

    def product(df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the preconditioned product of a and a column."""
        out = sparse.matvec(a, df.select(F.col("row").alias("col"), F.col(column).alias("x"))).withColumnRenamed("value", name)
        return df.join(out, "row", "left").withColumn(name, F.coalesce(name, F.lit(0.0)) / F.col("d"))

    target = tolerance * total(state, F.expr("b / d * b / d"))[0] ** 0.5
    for _ in range(rounds):
        state = product(state, "x", "r").withColumn("r", F.col("b") / F.col("d") - F.col("r"))
        state = _kept(state)
        beta = total(state, F.expr("r * r"))[0] ** 0.5
        if beta <= target:
            break
        h, basis, e = np.zeros((restart + 1, restart)), [F.col("v0")], np.zeros(restart + 1)
        e[0] = beta
        wide = state.withColumn("v0", F.col("r") / F.lit(beta)).drop("r")
        for k in range(restart):
            wide = _kept(product(wide, f"v{k}", "w"))
            first = total(wide, *(F.col("w") * v for v in basis))
            w = F.col("w") - sum((F.lit(c) * v for c, v in zip(first, basis, strict=True)), F.lit(0.0))
            *second, size = total(wide.withColumn("w", w), *(F.col("w") * v for v in basis), F.expr("w * w"))
            h[: k + 1, k] = np.add(first, second)
            h[k + 1, k] = max(size - float(np.dot(second, second)), 0.0) ** 0.5
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], e[: k + 2], rcond=None)
            if h[k + 1, k] < 1e-14 * beta or np.linalg.norm(h[: k + 2, : k + 1] @ y - e[: k + 2]) <= target:
                break
            if k + 1 < restart:
                new = F.col("w") - sum((F.lit(c) * v for c, v in zip(h[: k + 1, k].tolist(), basis, strict=True)), F.lit(0.0))
                wide = wide.withColumn(f"v{k + 1}", new / F.lit(float(h[k + 1, k]))).drop("w")
                basis.append(F.col(f"v{k + 1}"))
        moved = sum((F.lit(float(c)) * v for c, v in zip(y, basis, strict=True)), F.col("x"))
        state = _kept(wide.select("row", "d", moved.alias("x"), "b"))
    return state.select("row", "x")


def nelder_mead(f, start, rounds: int = 200, step: float = 0.5, tolerance: float = 1e-6):
    """The least point of f by the downhill simplex."""
    n = len(start)
    points = [np.asarray(start, float)] + [np.asarray(start, float) + step * e for e in np.eye(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        middle, worst = np.mean(points[:-1], axis=0), points[-1]
        trial = middle + (middle - worst)
        v = f(trial)
        if v < values[0]:
            far = middle + 2 * (middle - worst)
            w = f(far)
            trial, v = (far, w) if w < v else (trial, v)
        elif v >= values[-2]:
            near = middle + 0.5 * ((trial if v < values[-1] else worst) - middle)
            w = f(near)
            if w < min(v, values[-1]):
                trial, v = near, w
            else:
                points = [points[0] + 0.5 * (p - points[0]) for p in points]
                values = [values[0], *(f(p) for p in points[1:])]
                continue
        points[-1], values[-1] = trial, v
    i = int(np.argmin(values))
    return points[i], values[i]

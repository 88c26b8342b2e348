"""Equations on scattered nodes: collocation, steps in time, smoothing, and integration by boxes that halve."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.formulation import Operator
from pointloom.functions.polynomials import monomial_powers, monomials
from pointloom.operators import fd, sparse
from pointloom.operators.factors import MOST_ENTRIES, SparsePosDefSolver, entries
from pointloom.operators.interpolate import MOST_SITES, _kernel, default_order
from pointloom.operators.linalg import _kept, cg
from pointloom.operators.pairs import nearest_distance
from pointloom.sources.halton import halton
from pointloom.sources.points import coordinates


class Collocation:
    """The sum of kernels at all nodes, and monomials, that meets conditions (nodes, operator): operator of it is column d at those nodes.

    At most MOST_SITES nodes in all, which are gathered. Coefficients of operators are numbers.
    """

    def __init__(self, conditions: list[tuple[DataFrame, Operator]], phi="phs3", eps: float = 1.0, order: int | None = None):
        self.kernel, self.eps = _kernel(phi), eps
        self.order, self.x = default_order(self.kernel, order), coordinates(conditions[0][0])
        parts = [df.select(*self.x, F.col("d").cast("double")).orderBy(*self.x).limit(MOST_SITES + 1).toPandas() for df, _ in conditions]
        if sum(map(len, parts)) > MOST_SITES:
            raise ValueError(f"more than {MOST_SITES} nodes")
        self.y = np.concatenate([p[self.x].to_numpy(float) for p in parts])
        p = monomials(self.y, self.order)
        top = np.concatenate([self._rows(part[self.x].to_numpy(float), op.terms) for part, (_, op) in zip(parts, conditions, strict=True)])
        side = np.concatenate([p.T, np.zeros((p.shape[1],) * 2)], 1)
        right = np.concatenate([*(part["d"].to_numpy(float) for part in parts), np.zeros(p.shape[1])])
        self.c = np.linalg.solve(np.concatenate([top, side]), right)

    def _rows(self, at, terms) -> np.ndarray:
        powers = monomial_powers(self.order, len(self.x))
        out = np.zeros((len(at), len(self.y) + len(powers)))
        for diff, c in terms.items():
            out += c * np.concatenate([self.kernel.array(at, self.y, self.eps, diff), monomials(at, powers, diff)], 1)
        return out

    def __call__(self, points: DataFrame, operator: Operator | None = None) -> DataFrame:
        """(id, d) of the sum, or of an operator of it, at points."""
        terms = operator.terms if operator else {(0,) * len(self.x): 1.0}
        shared = points.sparkSession.sparkContext.broadcast((self, terms))

        def run(batches):
            fit, of = shared.value
            for rows in batches:
                for i in range(0, len(rows), 1000):
                    part = rows.iloc[i : i + 1000]
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "d": fit._rows(part[fit.x].to_numpy(float), of) @ fit.c})

        return points.select("id", *self.x).mapInPandas(run, "id bigint, d double")


def rk4(slope, state: DataFrame, step: float, steps: int) -> DataFrame:
    """(row, x) after so many steps of the classical fourth-order rule; slope takes and gives a frame (row, x), lacking rows being zero.

    A step is one job; its state is cut through the shared folder.
    """
    for _ in range(steps):
        moved, total = state, state.select("row", F.col("x").alias("u"))
        for k, (weight, ahead) in enumerate(((1, 0.5), (2, 0.5), (2, 1.0), (1, None))):
            s = _kept(slope(moved).select("row", F.col("x").alias(f"k{k}"))) if k < 3 else slope(moved).select("row", F.col("x").alias(f"k{k}"))
            total = total.join(s, "row", "left").withColumn(f"k{k}", F.coalesce(f"k{k}", F.lit(0.0)))
            if ahead:
                moved = total.select("row", (F.col("u") + F.lit(ahead * step) * F.col(f"k{k}")).alias("x"))
        state = _kept(total.select("row", (F.col("u") + F.lit(step / 6) * (F.col("k0") + 2 * F.col("k1") + 2 * F.col("k2") + F.col("k3"))).alias("x")))
    return state


def hyperviscosity(nodes: DataFrame, n: int, power: int = 2, factor: float = 1.0, **how) -> DataFrame:
    """The weights of -factor (-Laplacian)^power, which damps what a node set can't resolve."""
    lap = Operator.laplacian(len(coordinates(nodes)))
    op = lap
    for _ in range(power - 1):
        op = op * lap
    coefficients, diffs = (op * float(-factor * (-1) ** power)).parts()
    return fd.weight_matrix(nodes, nodes, n, diffs, coefficients, **how)


def low_pass(points: DataFrame, cutoff: float | None = None, order: int = 2, n: int | None = None, sigma: str | None = None, fill: str = "extrapolate", samples: int = 0, seed: int = 0, most: int = MOST_ENTRIES, **how) -> DataFrame:
    """(id, mean, sd) of values d of points, smoothed: features of wavelengths below 1 / cutoff go.

    The result u has the least sum of ((u - d) / sigma)^2 and ((u's derivatives of that order, summed over axes) / p)^2, where p is the
    level of sigma times (2 pi cutoff)^order; so for equal sigma a frequency f keeps 1 / (1 + (f / cutoff)^(2 order)) of itself. cutoff
    defaults to the frequency of 20 mean gaps. sigma names a column of standard deviations (1 if not given); a point where it or d is null
    has no value, and fill says whether it gets one ("extrapolate") or nulls ("none"). sd is exact up to most gathered entries; beyond,
    or if samples are asked, it comes from so many perturbed solutions, and is null without samples.
    """
    if fill not in ("extrapolate", "none"):
        raise ValueError("fill is extrapolate or none")
    x = coordinates(points)
    s = F.col(sigma).cast("double") if sigma else F.lit(1.0)
    data = points.select("id", *x, F.col("d").cast("double").alias("d"), F.when(F.col("d").isNotNull() & s.isNotNull(), 1.0 / (s * s)).otherwise(0.0).alias("w"))
    data = _kept(data.withColumn("d", F.coalesce("d", F.lit(0.0))))
    if cutoff is None:
        cutoff = 1 / (20 * nearest_distance(data.select("id", *x)).agg(F.avg("distance")).first()[0])
    level = data.where("w > 0").agg(F.avg("w")).first()[0]
    if level is None:
        raise ValueError("no point has a value")
    penalty = (2 * math.pi * cutoff) ** order / math.sqrt(level)
    diffs = [tuple(order * (k == i) for k in range(len(x))) for i in range(len(x))]
    stencil = n or 3 * math.comb(order + len(x), len(x))
    lap = _kept(fd.weight_matrix(data.select("id", *x), data.select("id", *x), min(stencil, data.count()), diffs, **how))
    rough = sparse.matmul(sparse.transpose(lap), lap).withColumn("value", F.col("value") / F.lit(penalty**2))
    a = _kept(sparse.canonical(rough.unionByName(data.select(F.col("id").alias("row"), F.col("id").alias("col"), F.col("w").alias("value")))))
    if a.limit(most + 1).count() <= most:
        rows = data.orderBy("id").toPandas()
        matrix, ids = entries(a, rows["id"].to_numpy(), most)
        solver, w = SparsePosDefSolver(matrix), rows["w"].to_numpy(float)
        mean = solver.solve(w * rows["d"].to_numpy(float))
        if samples:
            draws = np.random.default_rng(seed).standard_normal((len(w), samples))
            sd = solver.solve(np.sqrt(w)[:, None] * draws).std(1, ddof=1)
        else:
            sd = np.sqrt(np.concatenate([(solver.solve(np.eye(len(w))[:, i : i + 500]) ** 2 * w[:, None]).sum(0) for i in range(0, len(w), 500)]))
        out = points.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "mean": mean, "sd": sd}), "id bigint, mean double, sd double")
    else:
        solved = lambda right: cg(a, data.select(F.col("id").alias("row"), right.alias("value"))).select(F.col("row").alias("id"), "x")
        out = _kept(solved(F.col("w") * F.col("d")).select("id", F.col("x").alias("mean")))
        spread = data.select("id", F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))
        for k in range(samples):  # running sums of the perturbed solutions and their squares
            noise = F.expr(f"sqrt(-2 * ln((pmod(xxhash64(id, {seed}, {k}, 1), 1000003) + 1) / 1000004D)) * cos(2 * pi() * pmod(xxhash64(id, {seed}, {k}, 2), 1000003) / 1000003D)")
            spread = _kept(spread.join(solved(F.sqrt("w") * noise), "id").select("id", (F.col("s1") + F.col("x")).alias("s1"), (F.col("s2") + F.col("x") * F.col("x")).alias("s2")))
        sd = F.sqrt(F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / samples) / (samples - 1), F.lit(0.0))) if samples > 1 else F.lit(None).cast("double")
        out = out.join(spread, "id").select("id", "mean", sd.alias("sd"))
    if fill == "extrapolate":
        return out
    known = data.select("id", (F.col("w") > 0).alias("known"))
    return out.join(known, "id").select("id", *(F.when(F.col("known"), F.col(c)).alias(c) for c in ("mean", "sd")))


def recursive_monte_carlo(spark: SparkSession, f, low: list[float], high: list[float], samples: int | None = None, tolerance: float | None = None, depth: int = 50, domain=None) -> DataFrame:
    """One row: integral, error, boxes of f(columns) over a box, or a domain within it, from Halton points in boxes.

    A box whose standard error is over tolerance / 2^(its depth / 2) is halved across the axis that follows from its depth, down to depth.
    All open boxes of a depth are one job. tolerance defaults to a hundredth of the first estimate, samples to 20 to the power of the dimension.
    """
    dim = len(low)
    count = samples or 20**dim
    unit = F.broadcast(halton(spark, count, dim).select(*(F.col(f"x{k}").alias(f"u{k}") for k in range(dim))))
    ends = [f"{e}{k}" for e in ("lo", "hi") for k in range(dim)]
    boxes = spark.createDataFrame([(0, *map(float, low), *map(float, high))], "box long, " + ", ".join(f"{c} double" for c in ends))
    integral, variance, done = 0.0, 0.0, 0
    for level in range(depth + 1):
        points = boxes.crossJoin(unit).select(F.monotonically_increasing_id().alias("id"), "box", *ends, *((F.col(f"lo{k}") + F.col(f"u{k}") * (F.col(f"hi{k}") - F.col(f"lo{k}"))).alias(f"x{k}") for k in range(dim)))
        inside = F.lit(True)
        if domain is not None:
            points, inside = domain.contains(points), F.col("inside")
        v = F.when(inside, f([F.col(f"x{k}") for k in range(dim)])).otherwise(0.0)
        volume = F.lit(1.0)
        for k in range(dim):
            volume = volume * (F.col(f"hi{k}") - F.col(f"lo{k}"))
        found = points.select("box", *ends, v.cast("double").alias("v")).groupBy("box", *ends).agg(F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
        found = _kept(found.select("box", *ends, (volume * F.col("m")).alias("part"), (volume * F.col("s") / math.sqrt(count)).alias("error")))
        if tolerance is None:
            tolerance = abs(found.first().part) / 100
        fine = F.lit(True) if level == depth else F.col("error") <= tolerance / 2 ** (level / 2)
        own = found.where(fine).agg(F.sum("part").alias("p"), F.sum(F.col("error") * F.col("error")).alias("e"), F.count("*").alias("n")).first()
        integral, variance, done = integral + (own.p or 0.0), variance + (own.e or 0.0), done + own.n
        split = found.where(~fine)
        if level == depth or not split.limit(1).count():
            break
        axis = level % dim
        middle = (F.col(f"lo{axis}") + F.col(f"hi{axis}")) / 2
        halves = split.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("upper"))
        edge = {f"lo{axis}": F.when(F.col("upper") == 1, middle).otherwise(F.col(f"lo{axis}")), f"hi{axis}": F.when(F.col("upper") == 0, middle).otherwise(F.col(f"hi{axis}"))}
        boxes = _kept(halves.select((F.col("box") * 2 + F.col("upper")).alias("box"), *(edge.get(c, F.col(c)).alias(c) for c in ends)))
    return spark.createDataFrame([(integral, math.sqrt(variance), done)], "integral double, error double, boxes long")

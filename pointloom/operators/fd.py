"""Differentiation weights on irregular nodes: neighbours are joined, small systems are solved in Arrow batches, rows are (row, col, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.kernels import get_kernel
from pointloom.functions.polynomials import max_degree, monomial_powers, monomials
from pointloom.operators.pairs import knn
from pointloom.sources.points import coordinates


def weights(x, s, diffs, coeffs=None, phi="phs3", order: int | None = None, eps: float = 1.0, sum_terms: bool = True) -> np.ndarray:
    """Weights (..., N) or, for separate terms, (..., N, K), for targets x (..., D) and stencils s (..., N, D).

    The order defaults to the largest derivative, as far as the stencil determines it.
    """
    x, s = np.asarray(x, float), np.asarray(s, float)
    diffs = np.atleast_2d(diffs)
    kernel = get_kernel(phi) if isinstance(phi, str) else phi
    n, dim = s.shape[-2:]
    most = max_degree(n, dim)
    if order is None:
        order = min(max(int(diffs.sum(1).max()), kernel.cpd_order - 1), most)
    if order > most:
        raise ValueError(f"order {order} needs more than {n} nodes")
    s, x = s - x[..., None, :], np.zeros_like(x)
    powers = monomial_powers(order, dim)
    scale = np.abs(s).max((-2, -1))[..., None, None]
    scale = np.where(scale > 0, scale, 1.0)
    k = kernel.array(s, s, eps)
    p = monomials(s / scale, powers)
    size = np.ptp(k, axis=(-2, -1))[..., None, None]
    size = np.where(size > 0, size, 1.0)
    top = np.concatenate([k, p * size], -1)
    whole = np.concatenate([top, np.concatenate([np.swapaxes(p * size, -1, -2), np.zeros((*k.shape[:-2], len(powers), len(powers)))], -1)], -2)
    at = x[..., None, :]
    right = []
    for d in diffs:
        d = tuple(int(v) for v in d)
        kx = kernel.array(at, s, eps, d)[..., 0, :]
        px = (monomials(at / scale, powers, d) * size / scale ** sum(d))[..., 0, :]
        right.append(np.concatenate([kx, px], -1))
    right = np.stack(right, -1)
    c = np.ones(len(diffs)) if coeffs is None else np.asarray(coeffs, float)
    if sum_terms:
        right = (right * c[..., None, :] if c.ndim > 1 else right * c).sum(-1, keepdims=True)
        return np.linalg.solve(whole, right)[..., :n, 0]
    out = np.linalg.solve(whole, right)[..., :n, :]
    return out * (c[..., None, :] if c.ndim > 1 else c)


def weight_matrix(targets: DataFrame, nodes: DataFrame, n: int, diffs, coeffs: list | None = None, phi="phs3", order: int | None = None, eps: float = 1.0, sum_terms: bool = True) -> DataFrame:
    """(row, col, value), with term when terms stay apart: rows are target ids, columns node ids.

    coeffs are numbers or names of columns of targets, one for each derivative.
    """
    diffs = [tuple(int(v) for v in d) for d in np.atleast_2d(diffs)]
    x, coeffs = coordinates(targets), list(coeffs) if coeffs is not None else [1.0] * len(diffs)
    column = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double") if isinstance(c, Column) else F.lit(float(c))
    own = targets.select("id", *x, F.array(*(column(c) for c in coeffs)).alias("c"))
    near = knn(targets, nodes, n).select("i", "rank", "j")
    sites = nodes.select(F.col("id").alias("j"), *x)
    site = F.struct("rank", "j", *x)
    stencils = near.join(sites, "j").groupBy("i").agg(F.sort_array(F.collect_list(site)).alias("s")).withColumnRenamed("i", "id")
    flat = [F.col("s")[c].alias("s_" + c) for c in ("j", *x)]
    joined = own.join(stencils, "id").select("id", *x, "c", *flat)

    def run(batches):
        for rows in batches:
            for at in range(0, len(rows), 1000):
                part = rows.iloc[at : at + 1000]
                s = np.stack([np.stack(part["s_" + c].to_numpy()) for c in x], -1)
                w = weights(part[x].to_numpy(float), s, diffs, np.stack(part["c"].to_numpy()), phi, order, eps, sum_terms)
                m = len(part)
                w = w.reshape(m, n, -1)
                terms = w.shape[-1]
                out = {"row": np.repeat(part["id"].to_numpy(), n * terms), "col": np.repeat(np.concatenate(part["s_j"].to_numpy()), terms), "value": w.ravel()}
                if not sum_terms:
                    out["term"] = np.tile(np.arange(terms, dtype=np.int32), m * n)
                yield pd.DataFrame(out)

    return joined.mapInPandas(run, "row bigint, col bigint, value double" + ("" if sum_terms else ", term int"))


def _components(df: DataFrame, plan: dict[str, list[tuple[int, object]]]) -> dict[str, DataFrame]:
    """Matrices that are combinations (term, coefficient) of the terms of one solve."""
    out = {}
    for name, parts in plan.items():
        total = None
        for term, c in parts:
            t = df.where(F.col("term") == term).select("row", "col", (F.col("value") * c).alias("value"))
            total = t if total is None else total.unionByName(t)
        out[name] = total.groupBy("row", "col").agg(F.sum("value").alias("value"))
    return out


def _second(dim: int) -> list[tuple[int, ...]]:
    return [tuple((k == i) + (k == j) for k in range(dim)) for i in range(dim) for j in range(i, dim)]


def body_force(targets: DataFrame, nodes: DataFrame, n: int, lamb: float = 1.0, mu: float = 1.0, **how) -> dict[str, DataFrame]:
    """Elasticity in two or three dimensions: matrices xx, xy, .. from displacements to body forces; all share one solve."""
    dim = len(coordinates(targets))
    diffs = _second(dim)
    terms = weight_matrix(targets, nodes, n, diffs, sum_terms=False, **how)
    at = {d: i for i, d in enumerate(diffs)}
    pair = lambda i, j: at[tuple((k == i) + (k == j) for k in range(dim))]
    plan = {}
    for i in range(dim):
        for j in range(dim):
            if i == j:
                plan["xyz"[i] * 2] = [(pair(i, i), lamb + 2 * mu)] + [(pair(k, k), mu) for k in range(dim) if k != i]
            else:
                plan["xyz"[i] + "xyz"[j]] = [(pair(i, j), lamb + mu)]
    return _components(terms, plan)


def surface_force(targets: DataFrame, normals: list[str], nodes: DataFrame, n: int, lamb: float = 1.0, mu: float = 1.0, **how) -> dict[str, DataFrame]:
    """Matrices xx, xy, .. from displacements to tractions on surfaces whose normals are columns of targets."""
    dim = len(coordinates(targets))
    first = [tuple(int(k == i) for k in range(dim)) for i in range(dim)]
    terms = weight_matrix(targets, nodes, n, first, sum_terms=False, **how).join(targets.select(F.col("id").alias("row"), *normals), "row")
    nrm = [F.col(c) for c in normals]
    plan = {}
    for i in range(dim):
        for j in range(dim):
            if i == j:
                plan["xyz"[i] * 2] = [(i, (lamb + 2 * mu) * nrm[i])] + [(k, mu * nrm[k]) for k in range(dim) if k != i]
            else:
                plan["xyz"[i] + "xyz"[j]] = [(j, lamb * nrm[i]), (i, mu * nrm[j])]
    return _components(terms, plan)


def displacement(targets: DataFrame, nodes: DataFrame, n: int = 1, **how) -> dict[str, DataFrame]:
    """Matrices xx, yy, .. from displacements to themselves at the targets."""
    dim = len(coordinates(targets))
    same = weight_matrix(targets, nodes, n, [(0,) * dim], **how)
    return {"xyz"[i] * 2: same for i in range(dim)}

"""Point sets: id and coordinates x0.. (or an array x) as DataFrames, from tables, grids and closed shapes."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def as_points(df: DataFrame, id_column: str | Column, coordinates: list, **values) -> DataFrame:
    """id bigint, x0.. double and named value columns; timestamps become seconds."""
    def number(c):
        c = F.col(c) if isinstance(c, str) else c
        return c.cast("double")

    ident = F.col(id_column) if isinstance(id_column, str) else id_column
    return df.select(ident.cast("bigint").alias("id"), *(number(c).alias(f"x{i}") for i, c in enumerate(coordinates)), *(number(c).alias(n) for n, c in values.items()))


def coordinates(df: DataFrame) -> list[str]:
    """Names of the coordinate columns in order."""
    return sorted((c for c in df.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def dedupe_sites(points: DataFrame, how=F.avg) -> DataFrame:
    """One row for each site: the least id, values aggregated; coincident sites make kernel matrices singular."""
    x = coordinates(points)
    others = [c for c in points.columns if c not in ("id", *x)]
    return points.groupBy(*x).agg(F.min("id").alias("id"), *(how(c).alias(c) for c in others)).select("id", *x, *others)


def grid(spark: SparkSession, low: list[float], high: list[float], shape: list[int]) -> DataFrame:
    """A regular grid with both ends, the last axis fastest."""
    total, stride, cols = math.prod(shape), math.prod(shape), []
    for a, b, n in zip(low, high, shape, strict=True):
        stride //= n
        cols.append((F.lit(float(a)) + (F.pmod(F.floor(F.col("id") / F.lit(stride)), F.lit(n))) * F.lit((b - a) / max(n - 1, 1))))
    return spark.range(total).select("id", *(c.alias(f"x{i}") for i, c in enumerate(cols)))


def complex_frames(spark: SparkSession, vertices, simplices) -> tuple[DataFrame, DataFrame]:
    """vertices (v_id, x0..) and simplices (s_id, v0..) from arrays of numbers."""
    v, s = np.asarray(vertices, float), np.asarray(simplices, int)
    vf = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "v_id long, " + ", ".join(f"x{k} double" for k in range(v.shape[1])))
    sf = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(s)], "s_id long, " + ", ".join(f"v{k} long" for k in range(s.shape[1])))
    return vf, sf


def square() -> tuple[list, list]:
    """The unit square's outline."""
    return [[0, 0], [1, 0], [1, 1], [0, 1]], [[i, (i + 1) % 4] for i in range(4)]


def cube() -> tuple[list, list]:
    """The unit cube's surface: each face as two triangles, normals outward."""
    corner = [[i >> 2 & 1, i >> 1 & 1, i & 1] for i in range(8)]
    faces = []
    for axis in range(3):
        u, w = 4 >> (axis + 1) % 3, 4 >> (axis + 2) % 3
        for side in (0, 1):
            a = (4 >> axis) * side
            quad = [a, a + u, a + u + w, a + w]
            quad = quad if side else quad[::-1]
            faces += [[quad[0], quad[1], quad[2]], [quad[0], quad[2], quad[3]]]
    return corner, faces


def circle(refinements: int = 5) -> tuple[list, list]:
    """4 * 2**refinements equally spaced vertices on the unit circle."""
    n = 4 << refinements
    return [[math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)] for i in range(n)], [[i, (i + 1) % n] for i in range(n)]


def sphere(refinements: int = 5) -> tuple[list, list]:
    """8 * 4**refinements triangles on the unit sphere, from an octahedron whose edges are halved."""
    tri = []
    for sx in (1, -1):
        for sy in (1, -1):
            for sz in (1, -1):
                t = [[sx, 0, 0], [0, sy, 0], [0, 0, sz]]
                tri.append(t if sx * sy * sz > 0 else t[::-1])
    t = np.array(tri, float)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    for _ in range(refinements):
        a, b, c = t[:, 0], t[:, 1], t[:, 2]
        ab, bc, ca = unit(a + b), unit(b + c), unit(c + a)
        t = np.concatenate([np.stack(x, 1) for x in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))])
    vertices, index = np.unique(t.reshape(-1, 3).round(14), axis=0, return_inverse=True)
    return vertices.tolist(), index.reshape(-1, 3).tolist()

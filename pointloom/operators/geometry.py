"""Points and segments against polygons and triangulated surfaces, as column expressions.

A domain is vertices (v_id, x0..) and simplices (s_id, v0..), of two or three dimensions. Its simplices are small beside the points; they
are counted, gathered into one row (by bands of the last axis where that prunes) and broadcast, and every test runs within a point's row:
points are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.pairs import nearest_distance, squared_distance
from pointloom.sources.points import coordinates

#: Simplices of a domain, at most.
MOST_SIMPLICES = 1_000_000
AXES = "abc"


def _minus(p, q):
    return [x - y for x, y in zip(p, q, strict=True)]


def _dot(p, q):
    return sum((x * y for x, y in zip(p[1:], q[1:], strict=True)), p[0] * q[0])


def _cross(p, q):
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def normal_of(corners) -> list[Column]:
    """Unnormalised normal of a segment or triangle."""
    if len(corners[0]) == 2:
        d = _minus(corners[1], corners[0])
        return [d[1], -d[0]]
    return _cross(_minus(corners[1], corners[0]), _minus(corners[2], corners[0]))


def simplex_frame(vertices: DataFrame, simplices: DataFrame) -> DataFrame:
    """(s_id, a0.., b0.., ..): simplices with their corners' coordinates."""
    x = coordinates(vertices)
    out = simplices.select("s_id", *(f"v{k}" for k in range(len(x))))
    for k in range(len(x)):
        corner = vertices.select(F.col("v_id").alias(f"v{k}"), *(F.col(c).alias(AXES[k] + c[1:]) for c in x))
        out = out.join(corner, f"v{k}")
    return out.select("s_id", *(f"{AXES[k]}{i}" for k in range(len(x)) for i in range(len(x))))


def _corners(s, dim: int) -> list[list[Column]]:
    return [[s[f"{AXES[k]}{i}"] for i in range(dim)] for k in range(dim)]


class Domain:
    """A closed outline or surface."""

    def __init__(self, vertices: DataFrame, simplices: DataFrame):
        self.vertices, self.simplices, self.dim = vertices, simplices, len(coordinates(vertices))
        if self.dim not in (2, 3):
            raise ValueError("domains have two or three dimensions")
        self.frame = simplex_frame(vertices, simplices)
        self.count = simplices.count()
        if self.count > MOST_SIMPLICES:
            raise ValueError(f"a domain of {self.count} simplices; at most {MOST_SIMPLICES} are broadcast")

    def __repr__(self) -> str:
        return f"Domain(dim={self.dim}, simplices={self.count})"

    def _with_all(self, df: DataFrame) -> DataFrame:
        row = self.frame.agg(F.array_sort(F.collect_list(F.struct(*self.frame.columns))).alias("_all"))
        return df.crossJoin(F.broadcast(row))

    def normals(self) -> DataFrame:
        """(s_id, n0..): unit normals."""
        n = normal_of([[F.col(f"{AXES[k]}{i}") for i in range(self.dim)] for k in range(self.dim)])
        size = F.sqrt(_dot(n, n))
        return self.frame.select("s_id", *((c / size).alias(f"n{i}") for i, c in enumerate(n)))

    def contains(self, points: DataFrame) -> DataFrame:
        """points with inside: an odd number of crossings of the ray along the first axis, edges half open."""
        last = f"{self.dim - 1}"
        ends = [F.col(f"{AXES[k]}{last}") for k in range(self.dim)]
        box = self.frame.agg(F.min(F.least(*ends)).alias("lo"), F.max(F.greatest(*ends)).alias("hi")).first()
        bands = max(1, min(1024, self.count // 2))
        width = (box.hi - box.lo) / bands or 1.0
        at = lambda c: F.least(F.greatest(F.floor((c - box.lo) / width), F.lit(-1)), F.lit(bands)).cast("int")
        banded = self.frame.select(F.struct(*self.frame.columns).alias("s"), F.explode(F.sequence(at(F.least(*ends)), at(F.greatest(*ends)))).alias("band"))
        banded = banded.groupBy("band").agg(F.collect_list("s").alias("_own"))
        x = coordinates(points)
        p = [F.col(c) for c in x]
        df = points.withColumn("band", at(p[-1])).join(F.broadcast(banded), "band", "left")
        hits = F.size(F.filter("_own", lambda s: _ray_hits(p, _corners(s, self.dim))))
        return df.withColumn("inside", F.coalesce(F.pmod(hits, F.lit(2)) == 1, F.lit(False)) & F.col("_own").isNotNull()).drop("band", "_own")

    def nearest(self, points: DataFrame) -> DataFrame:
        """points with s_id, distance and the nearest boundary point n0..; ties to the smaller s_id."""
        p = [F.col(c) for c in coordinates(points)]

        def one(s):
            q = nearest_on(p, _corners(s, self.dim))
            return F.struct(squared_distance(p, q).alias("d2"), s["s_id"].alias("s_id"), *(c.alias(f"n{i}") for i, c in enumerate(q)))

        df = self._with_all(points).withColumn("_near", F.array_min(F.transform("_all", one)))
        return df.select(*points.columns, F.col("_near.s_id"), F.sqrt("_near.d2").alias("distance"), *(F.col(f"_near.n{i}") for i in range(self.dim)))

    def intersection_count(self, segments: DataFrame) -> DataFrame:
        """segments (id, a0.., b0..) with count of simplices crossed; a shared edge counts for each."""
        start, stop = ([F.col(f"{e}{i}") for i in range(self.dim)] for e in "ab")
        hits = F.size(F.filter("_all", lambda s: crosses(start, stop, _corners(s, self.dim))))
        return self._with_all(segments).withColumn("count", hits.cast("bigint")).drop("_all")

    def first_hit(self, segments: DataFrame, required: bool = False) -> DataFrame:
        """segments with s_id and point h0.. of the crossing nearest to the start; null where there is none, or a ValueError if required."""
        start, stop = ([F.col(f"{e}{i}") for i in range(self.dim)] for e in "ab")
        crossed = F.filter("_all", lambda s: crosses(start, stop, _corners(s, self.dim)))
        timed = F.transform(crossed, lambda s: F.struct(crossing_time(start, stop, _corners(s, self.dim)).alias("t"), s["s_id"].alias("s_id")))
        df = self._with_all(segments).withColumn("_hit", F.array_min(timed))
        point = [(a + F.col("_hit.t") * (b - a)).alias(f"h{i}") for i, (a, b) in enumerate(zip(start, stop, strict=True))]
        out = df.select(*segments.columns, F.col("_hit.s_id"), *point)
        if required and out.where("s_id is null").limit(1).count():
            raise ValueError("a segment crosses no simplex")
        return out

    def snap(self, points: DataFrame, delta: float = 0.5) -> DataFrame:
        """points moved to the boundary where it is nearer than delta times the nearest other point; s_id is -1 elsewhere."""
        gap = nearest_distance(points).select(F.col("i").alias("id"), F.col("distance").alias("gap"))
        df = self.nearest(points).join(gap, "id")
        near = F.col("distance") < delta * F.col("gap")
        x = coordinates(points)
        moved = [F.when(near, F.col(f"n{i}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(x)]
        rest = [c for c in points.columns if c not in ("id", *x)]
        return df.select("id", *moved, *rest, F.when(near, F.col("s_id")).otherwise(F.lit(-1).cast("bigint")).alias("s_id"))

    def oriented(self) -> Domain:
        """The same domain with all normals outward: where a point just off the middle along the normal is inside, two corners swap."""
        corners = [[F.col(f"{AXES[k]}{i}") for i in range(self.dim)] for k in range(self.dim)]
        spans = self.vertices.agg(*(F.max(c).alias("h" + c) for c in coordinates(self.vertices)), *(F.min(c).alias("l" + c) for c in coordinates(self.vertices))).first()
        scale = max(spans["h" + c] - spans["l" + c] for c in coordinates(self.vertices))
        n = normal_of(corners)
        size = F.sqrt(_dot(n, n))
        middle = [sum((c[i] for c in corners[1:]), corners[0][i]) / self.dim + 1e-10 * scale * n[i] / size for i in range(self.dim)]
        pushed = self.frame.select(F.col("s_id").alias("id"), *(m.alias(f"x{i}") for i, m in enumerate(middle)))
        inside = self.contains(pushed).select(F.col("id").alias("s_id"), "inside")
        df = self.simplices.join(inside, "s_id")
        first = [F.when(F.col("inside"), F.col("v1")).otherwise(F.col("v0")).alias("v0"), F.when(F.col("inside"), F.col("v0")).otherwise(F.col("v1")).alias("v1")]
        return Domain(self.vertices, df.select("s_id", *first, *(f"v{k}" for k in range(2, self.dim))))

    def volume(self) -> DataFrame:
        """One row: the area or volume within, positive if the normals point outward."""
        x = coordinates(self.vertices)
        mid = self.vertices.agg(*(F.avg(c).alias("m" + c[1:]) for c in x))
        df = self.frame.crossJoin(F.broadcast(mid))
        c = [[F.col(f"{AXES[k]}{i}") - F.col(f"m{i}") for i in range(self.dim)] for k in range(self.dim)]
        det = c[0][0] * c[1][1] - c[0][1] * c[1][0] if self.dim == 2 else _dot(c[0], _cross(c[1], c[2]))
        return df.agg((F.sum(det) / math.factorial(self.dim)).alias("volume"))


def _edge_below(p1, p2, u, v) -> Column:
    """Whether the edge u-v, in the plane of the last two coordinates, crosses the ray from (p1, p2) along the first of them; half open."""
    swap = u[1] > v[1]
    lo, hi = ([F.when(swap, b).otherwise(a) for a, b in zip(u, v, strict=True)], [F.when(swap, a).otherwise(b) for a, b in zip(u, v, strict=True)])
    return ((u[1] > p2) != (v[1] > p2)) & (p1 < lo[0] + (p2 - lo[1]) * (hi[0] - lo[0]) / (hi[1] - lo[1]))


def _ray_hits(p, corners) -> Column:
    if len(p) == 2:
        return _edge_below(p[0], p[1], *corners)
    flat = [c[1:] for c in corners]
    within = sum((_edge_below(p[1], p[2], flat[i], flat[(i + 1) % 3]).cast("int") for i in (1, 2)), _edge_below(p[1], p[2], flat[0], flat[1]).cast("int"))
    n = normal_of(corners)
    ahead = _dot(n, _minus(corners[0], p)) / n[0]
    return (F.pmod(within, F.lit(2)) == 1) & (n[0] != 0) & (ahead > 0)


def crossing_time(start, stop, corners) -> Column:
    n = normal_of(corners)
    s, e = _dot(n, _minus(start, corners[0])), _dot(n, _minus(stop, corners[0]))
    return s / (s - e)


def crosses(start, stop, corners) -> Column:
    """Whether start-stop passes the simplex: its ends are on different sides, and the point lies on it, borders included."""
    n = normal_of(corners)
    s, e = F.signum(_dot(n, _minus(start, corners[0]))), F.signum(_dot(n, _minus(stop, corners[0])))
    t = crossing_time(start, stop, corners)
    q = [a + t * (b - a) for a, b in zip(start, stop, strict=True)]
    tiny = 1e-12
    if len(start) == 2:
        d = _minus(corners[1], corners[0])
        u = _dot(_minus(q, corners[0]), d) / _dot(d, d)
        return (s != e) & (u >= -tiny) & (u <= 1 + tiny)
    u, v = _barycentric(q, corners)
    return (s != e) & (u >= -tiny) & (v >= -tiny) & (u + v <= 1 + tiny)


def _barycentric(q, corners):
    e1, e2, w = _minus(corners[1], corners[0]), _minus(corners[2], corners[0]), _minus(q, corners[0])
    a, b, c, d, e = _dot(e1, e1), _dot(e1, e2), _dot(e2, e2), _dot(w, e1), _dot(w, e2)
    det = a * c - b * b
    return (c * d - b * e) / det, (a * e - b * d) / det


def orthogonal(v: list[Column]) -> list[Column]:
    """A unit vector orthogonal to v: in the plane v turned left; in space the product with the axis along which v is shortest."""
    if len(v) == 2:
        w = [-v[1], v[0]]
    else:
        x, y, z = map(F.abs, v)
        pick = lambda a, b, c: F.when((x <= y) & (x <= z), a).when(y <= z, b).otherwise(c)
        zero = F.lit(0.0)
        w = [pick(zero, -v[2], v[1]), pick(v[2], zero, -v[0]), pick(-v[1], v[0], zero)]
    size = F.sqrt(_dot(w, w))
    return [c / size for c in w]


def in_segment(p, a, b) -> Column:
    """Whether the foot of p on the line a b lies between a and b, ends included."""
    d = _minus(b, a)
    t = _dot(_minus(p, a), d) / _dot(d, d)
    return (t >= 0) & (t <= 1)


def in_triangle(p, a, b, c) -> Column:
    """Whether the foot of p on the plane of the triangle lies in it, edges included."""
    u, v = _barycentric(p, [a, b, c])
    return (u >= 0) & (v >= 0) & (u + v <= 1)


def _on_segment(p, a, b):
    d = _minus(b, a)
    t = F.least(F.greatest(_dot(_minus(p, a), d) / _dot(d, d), F.lit(0.0)), F.lit(1.0))
    return [x + t * y for x, y in zip(a, d, strict=True)]


def nearest_on(p, corners) -> list[Column]:
    """The simplex's point nearest to p."""
    if len(p) == 2:
        return _on_segment(p, *corners)
    u, v = _barycentric(p, corners)
    a, b, c = corners
    flat = [x + u * (y - x) + v * (z - x) for x, y, z in zip(a, b, c, strict=True)]
    edges = [_on_segment(p, a, b), _on_segment(p, b, c), _on_segment(p, c, a)]
    d = [squared_distance(p, q) for q in edges]
    inside = (u >= 0) & (v >= 0) & (u + v <= 1)
    pick = lambda i: F.when(inside, flat[i]).when((d[0] <= d[1]) & (d[0] <= d[2]), edges[0][i]).when(d[1] <= d[2], edges[1][i]).otherwise(edges[2][i])
    return [pick(i) for i in range(3)]

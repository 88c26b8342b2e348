"""Node generation inside domains: sampling, Poisson discs, dispersion, snapping, groups, ghosts and ordering.

Densities and radii are functions of coordinate columns. Steps that iterate cut their lineage in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.geometry import Domain
from pointloom.operators.linalg import _kept
from pointloom.operators.pairs import knn, nearest_distance, radius_join
from pointloom.sources.halton import halton, radical_inverse, uniform
from pointloom.sources.points import complex_frames, coordinates


def as_domain(spark: SparkSession, domain) -> Domain:
    """A Domain, or (vertices, simplices) as arrays."""
    return domain if isinstance(domain, Domain) else Domain(*complex_frames(spark, *domain))


def bounds(domain: Domain) -> tuple[list[float], list[float]]:
    x = coordinates(domain.vertices)
    r = domain.vertices.agg(*(F.min(c).alias("l" + c) for c in x), *(F.max(c).alias("h" + c) for c in x)).first()
    return [r["l" + c] for c in x], [r["h" + c] for c in x]


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in coordinates(df)]


def rejection_sampling(spark: SparkSession, size: int, domain: Domain, rho=None, start: int = 0, most: int = 1_000_000) -> DataFrame:
    """size points in the domain with density rho (up to 1): Halton points kept where another Halton number is below it."""
    low, high = bounds(domain)
    batch, done, have = 2 * size, None, 0
    while have < size:
        points = uniform(halton(spark, batch, len(low), start, prime_index=1), low, high)
        u = radical_inverse(F.col("id") + F.lit(start + 1), 2, start + batch + 1)
        kept = points if rho is None else points.where(rho(_columns(points)) > u)
        kept = domain.contains(kept).where("inside").drop("inside").withColumn("id", F.col("id") + F.lit(start))
        done = kept if done is None else done.unionByName(kept)
        found = kept.count()
        have, start = have + found, start + batch
        batch = min(most, max(size, math.ceil(1.2 * max(size - have, 0) * batch / max(found, 1))))
    return numbered(done.orderBy("id").limit(size), "id").select(F.col("place").alias("id"), *coordinates(done))


def poisson_discs(spark: SparkSession, domain: Domain, radius, least: float, most: float, oversampling: float = 8.0, start: int = 0) -> DataFrame:
    """Points no two of which are nearer than the larger radius of both, chosen from Halton candidates until none more fits.

    radius(columns) lies between least and most. Earlier candidates win; undecided ones wait for earlier neighbours, round by round.
    """
    low, high = bounds(domain)
    count = math.ceil(oversampling * math.prod((h - l) / least for l, h in zip(low, high, strict=True)))
    candidates = uniform(halton(spark, count, len(low), start), low, high)
    candidates = _kept(domain.contains(candidates).where("inside").drop("inside"))
    x = coordinates(candidates)
    near = radius_join(candidates, candidates, most).where("i < j")
    ra, rb = radius([F.col("a" + c) for c in x]), radius([F.col("b" + c) for c in x])
    conflicts = _kept(near.where(F.col("d2") < F.pow(F.greatest(ra, rb), F.lit(2.0))).select("i", "j"))
    undecided, chosen = candidates.select("id"), None
    while True:
        blocked = conflicts.select(F.col("j").alias("id")).distinct()
        won = _kept(undecided.join(blocked, "id", "left_anti"))
        chosen = won if chosen is None else _kept(chosen.unionByName(won))
        lost = conflicts.join(won.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id")).distinct()
        undecided = _kept(undecided.join(won.unionByName(lost), "id", "left_anti"))
        if undecided.limit(1).count() == 0:
            return candidates.join(chosen, "id")
        left = undecided.withColumnRenamed("id", "i")
        conflicts = _kept(conflicts.join(left, "i", "left_semi").join(left.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j"))


def disperse(nodes: DataFrame, domain: Domain, iterations: int = 20, rho=None, fixed: DataFrame | None = None, neighbors: int | None = None, delta: float = 0.1) -> DataFrame:
    """Nodes pushed apart by their neighbours and by fixed nodes; a step over the boundary is mirrored at it, or undone if that fails."""
    x = coordinates(nodes)
    k = neighbors or (3 if len(x) == 2 else 4)
    spark = nodes.sparkSession
    fixed_rows = fixed.select((-F.col("id") - 1).alias("id"), *x) if fixed is not None else None
    nodes = nodes.select("id", *x)
    for _ in range(iterations):
        everyone = nodes if fixed_rows is None else nodes.unionByName(fixed_rows)
        near = knn(nodes, everyone, k, exclude_self=True)
        a = nodes.select(F.col("id").alias("i"), *(F.col(c).alias("a" + c) for c in x))
        b = everyone.select(F.col("id").alias("j"), *(F.col(c).alias("b" + c) for c in x))
        pair = near.join(a, "i").join(b, "j")
        weight = F.pow("d2", F.lit(-1.5))
        if rho is not None:
            weight = weight / (rho([F.col("a" + c) for c in x]) * rho([F.col("b" + c) for c in x]))
        push = pair.where("d2 > 0").groupBy("i").agg(*(F.sum((F.col("a" + c) - F.col("b" + c)) * weight).alias("f" + c) for c in x), F.min(F.sqrt("d2")).alias("gap"))
        size = F.sqrt(sum((F.col("f" + c) * F.col("f" + c) for c in x), F.lit(0.0)))
        step = {c: F.when(size > 0, F.col("f" + c) / size * delta * F.col("gap")).otherwise(0.0) for c in x}
        moved = nodes.join(push.withColumnRenamed("i", "id"), "id", "left")
        moved = moved.select("id", *(F.col(c).alias(f"a{i}") for i, c in enumerate(x)), *((F.col(c) + F.coalesce(step[c], F.lit(0.0))).alias(f"b{i}") for i, c in enumerate(x)))
        hit = domain.first_hit(moved).join(domain.normals(), "s_id", "left")
        over = sum(((F.col(f"b{i}") - F.col(f"h{i}")) * F.col(f"n{i}") for i in range(1, len(x))), (F.col("b0") - F.col("h0")) * F.col("n0"))
        bounced = hit.select("id", "s_id", *(f"a{i}" for i in range(len(x))), *(F.when(F.col("s_id").isNull(), F.col(f"b{i}")).otherwise(F.col(f"b{i}") - 2 * over * F.col(f"n{i}")).alias(f"b{i}") for i in range(len(x))))
        out = domain.contains(bounced.select("*", *(F.col(f"b{i}").alias(f"x{i}") for i in range(len(x)))))
        good = F.col("inside") | F.col("s_id").isNull()
        nodes = _kept(out.select("id", *(F.when(good, F.col(f"b{i}")).otherwise(F.col(f"a{i}")).alias(f"x{i}") for i in range(len(x)))))
    assert spark is not None
    return nodes


def z_order(nodes: DataFrame, bits: int = 16) -> DataFrame:
    """nodes with a key that follows a space-filling curve, so that near nodes get near keys."""
    x = coordinates(nodes)
    r = nodes.agg(*(F.min(c).alias("l" + c) for c in x), *(F.max(c).alias("h" + c) for c in x)).first()
    cells = [F.floor((F.col(c) - r["l" + c]) / F.lit((r["h" + c] - r["l" + c]) or 1.0) * ((1 << bits) - 1)).cast("bigint") for c in x]
    key = F.lit(0).cast("bigint")
    for b in range(bits):
        for i, c in enumerate(cells):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), b * len(x) + i))
    return nodes.withColumn("key", key)


def reordered(nodes: DataFrame) -> DataFrame:
    """nodes with ids in curve order."""
    return numbered(z_order(nodes), "key", "id").withColumn("id", F.col("place")).drop("key", "place")


def neighbor_order(nodes: DataFrame, m: int | None = None) -> DataFrame:
    """(id, place): reverse Cuthill-McKee order of the graph that links each node with its m nearest (itself included; 5 for each power of
    the dimension). The graph is gathered, so for more nodes than factors.MOST_ENTRIES / m use reordered.
    """
    from pointloom.operators.factors import cuthill_mckee, entries

    n = nodes.count()
    if not n:
        return nodes.select("id", F.col("id").alias("place"))
    near = knn(nodes, nodes, min(n, m or 5 ** len(coordinates(nodes))))
    graph, ids = entries(near.select(F.col("i").alias("row"), F.col("j").alias("col"), F.lit(1.0).alias("value")))
    order = cuthill_mckee(graph.rows, graph.cols, graph.n)
    return nodes.sparkSession.createDataFrame(pd.DataFrame({"id": ids[order], "place": np.arange(n)}), "id bigint, place bigint")


def save_points(points: DataFrame, path: str, files: int | None = None) -> None:
    """points as Parquet files that each hold near points, so that ranges of coordinates prune files and row groups."""
    keyed = z_order(points)
    dealt = keyed.repartitionByRange(files, "key") if files else keyed.repartitionByRange("key")
    dealt.sortWithinPartitions("key").drop("key").write.parquet(path)


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df with place, from 0 in the order of keys: ranges are sorted apart, and only their sizes are gathered."""
    sorted_ = _kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    sized = sorted_.withColumn("_p", F.shiftright("_m", 33))
    before, total = {}, 0
    for r in sized.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        before[r["_p"]], total = total, total + r["n"]
    first = F.element_at(F.create_map(*(F.lit(v) for kv in before.items() for v in kv)).cast("map<bigint,bigint>"), F.col("_p")) if before else F.lit(0)
    return sized.withColumn("place", (first + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("_m", "_p")


def check_spacing(nodes: DataFrame, rho=None) -> DataFrame:
    """One row: n, duplicates, and sparse, the nodes whose density is far below the median in logarithms."""
    x = coordinates(nodes)
    gap = nearest_distance(nodes).select(F.col("i").alias("id"), "distance")
    density = (rho(_columns(nodes)) if rho is not None else F.lit(1.0)) * 1.0
    df = nodes.join(gap, "id").select("distance", F.log10(F.when(F.col("distance") > 0, F.pow("distance", F.lit(-float(len(x)))) / density)).alias("q"))
    p = df.agg(F.expr("percentile(q, array(0.1, 0.5, 0.9))").alias("p"))
    low = F.col("p")[1] - 2 * (F.col("p")[2] - F.col("p")[0])
    return df.crossJoin(F.broadcast(p)).agg(F.count("*").alias("n"), F.sum((F.col("distance") == 0).cast("int")).cast("bigint").alias("duplicates"), F.coalesce(F.sum((F.col("q") < low).cast("int")), F.lit(0)).cast("bigint").alias("sparse"))


def prepare_nodes(nodes: DataFrame, domain: Domain, rho=None, iterations: int = 20, snap_delta: float = 0.5, boundary_groups: dict[str, list[int]] | None = None, ghosts: list[str] | None = None, ghost_delta: float = 0.5, pinned: DataFrame | None = None, include_vertices: bool = False) -> DataFrame:
    """id, x0.., grp, n0..: dispersed nodes snapped to the boundary, with groups, normals (null inside) and ghost nodes, in curve order."""
    domain = domain.oriented()
    x = coordinates(nodes)
    nodes = disperse(nodes, domain, iterations, rho, pinned)
    if include_vertices:
        n = nodes.agg(F.max("id")).first()[0] + 1
        nodes = nodes.unionByName(domain.vertices.select((F.col("v_id") + n).alias("id"), *x))
    snapped = _kept(domain.snap(nodes, snap_delta)).join(domain.normals(), "s_id", "left")
    groups = boundary_groups or {"all": None}
    unknown = [s for own in groups.values() if own for s in own]
    if unknown and domain.simplices.where(F.col("s_id").isin(unknown)).count() != len(set(unknown)):
        raise ValueError("groups name simplices that the domain doesn't have")
    if len(unknown) != len(set(unknown)):
        raise ValueError("a simplex is in several groups")
    name = F.when(F.col("s_id") < 0, F.lit("interior"))
    for g, own in groups.items():
        name = name.when(F.col("s_id").isin(own) if own is not None else F.lit(True), F.lit(f"boundary:{g}"))
    out = snapped.select("id", *x, name.otherwise("boundary:other").alias("grp"), *(f"n{i}" for i in range(len(x))))
    if pinned is not None:
        n = out.agg(F.max("id")).first()[0] + 1
        out = out.unionByName(pinned.select((F.col("id") + n).alias("id"), *x, F.lit("pinned").alias("grp"), *(F.lit(None).cast("double").alias(f"n{i}") for i in range(len(x)))))
    if ghosts:
        gap = nearest_distance(out.select("id", *x)).select(F.col("i").alias("id"), "distance")
        n = out.agg(F.max("id")).first()[0] + 1
        own = out.where(F.col("grp").isin([f"boundary:{g}" for g in ghosts])).join(gap, "id")
        added = own.select((F.col("id") + n).alias("id"), *((F.col(c) + ghost_delta * F.col("distance") * F.col(f"n{i}")).alias(c) for i, c in enumerate(x)), F.regexp_replace("grp", "^boundary", "ghosts").alias("grp"), *(F.lit(None).cast("double").alias(f"n{i}") for i in range(len(x))))
        out = out.unionByName(added)
    return reordered(out)


def group_indices(nodes: DataFrame) -> DataFrame:
    """(grp, ids)."""
    return nodes.groupBy("grp").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def min_energy_nodes(spark: SparkSession, n: int, domain, rho=None, start: int = 0, **how) -> DataFrame:
    domain = as_domain(spark, domain)
    return prepare_nodes(rejection_sampling(spark, n, domain, rho, start), domain, rho, **how)


def poisson_disc_nodes(spark: SparkSession, radius, domain, least: float | None = None, most: float | None = None, **how) -> DataFrame:
    """radius: a number, or a function of coordinates with its bounds least and most."""
    domain = as_domain(spark, domain)
    f = radius if callable(radius) else (lambda x: F.lit(float(radius)))
    low, high = (radius, radius) if not callable(radius) else (least, most)
    discs = poisson_discs(spark, domain, f, low, high)
    rho = None if not callable(radius) else (lambda x: F.pow(f(x), F.lit(-float(len(x)))))
    return prepare_nodes(discs, domain, rho, **how)


def monte_carlo(spark: SparkSession, f, low: list[float], high: list[float], samples: int, domain: Domain | None = None, start: int = 0) -> DataFrame:
    """One row: integral, error, least and most of f(columns) over a box or domain, from Halton points."""
    points = uniform(halton(spark, samples, len(low), start), low, high)
    inside = F.lit(True)
    if domain is not None:
        points, inside = domain.contains(points), F.col("inside")
    v = F.when(inside, f(_columns(points))).otherwise(0.0)
    volume = math.prod(h - l for l, h in zip(low, high, strict=True))
    return points.select(v.cast("double").alias("v"), inside.alias("i")).agg((volume * F.avg("v")).alias("integral"), (volume * F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("error"), F.min(F.when(F.col("i"), F.col("v"))).alias("least"), F.max(F.when(F.col("i"), F.col("v"))).alias("most"))


def density_normalizer(spark: SparkSession, rho, domain: Domain, count: int, samples: int = 100_000) -> float:
    """The factor that makes rho integrate to count over the domain."""
    low, high = bounds(domain)
    return count / monte_carlo(spark, rho, low, high, samples, domain).first().integral


def max_normalizer(spark: SparkSession, rho, domain: Domain, samples: int = 100_000) -> float:
    """The factor that makes rho's greatest sampled value 1."""
    low, high = bounds(domain)
    return 1.0 / monte_carlo(spark, rho, low, high, samples, domain).first().most

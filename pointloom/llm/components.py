"""Connected components by alternating star contractions: every step is a grouped minimum and a join, written to shared storage."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.shared import discard, stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges with the least neighbour of u (or u itself)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))


def _loose(edges: DataFrame) -> int:
    """Nodes that keep edges (u, v), u > v, from being stars around each component's least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").count()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (u, v bigint) to a smaller node: label is the least node of its component, itself left out."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while _loose(now):
        before, now = now, stored(_small_star(_large_star(now)).where("u <> v").distinct(), "edges")
        discard(before)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out._stored_at = now._stored_at
    return out

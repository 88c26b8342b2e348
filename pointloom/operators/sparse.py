"""Matrices as (row, col, value) rows; repeated places add up."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(a: DataFrame) -> DataFrame:
    return a.groupBy("row", "col").agg(F.sum("value").alias("value"))


def expand_rows(a: DataFrame, places: DataFrame) -> DataFrame:
    """Rows renamed by places (row, new)."""
    return a.join(places, "row").select(F.col("new").alias("row"), "col", "value")


def expand_cols(a: DataFrame, places: DataFrame) -> DataFrame:
    """Columns renamed by places (col, new)."""
    return a.join(places, "col").select("row", F.col("new").alias("col"), "value")


def add_rows(a: DataFrame, b: DataFrame, places: DataFrame) -> DataFrame:
    """a plus b's rows at the places (row, new) of a."""
    return canonical(a.select("row", "col", "value").unionByName(expand_rows(b, places)))


def divide_rows(a: DataFrame, x: DataFrame) -> DataFrame:
    """Each row divided by x (row, x)."""
    return a.join(x, "row").select("row", "col", (F.col("value") / F.col("x")).alias("value"))


def row_norms(a: DataFrame, order: float = 2) -> DataFrame:
    """(row, norm) of the canonical matrix."""
    size = F.abs("value") if order == 1 else F.col("value") * F.col("value") if order == 2 else F.pow(F.abs("value"), F.lit(float(order)))
    total = F.sum(size)
    return canonical(a).groupBy("row").agg((total if order == 1 else F.sqrt(total) if order == 2 else F.pow(total, F.lit(1.0 / order))).alias("norm"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(row, value) of a times x (col, x)."""
    return a.join(x, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("row").alias("k"), F.col("col").alias("c"), F.col("value").alias("w"))
    left = a.select("row", F.col("col").alias("k"), "value")
    return left.join(right, "k").groupBy("row", F.col("c").alias("col")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def diagonal(x: DataFrame) -> DataFrame:
    """x (row, x) as a diagonal matrix."""
    return x.select("row", F.col("row").alias("col"), F.col("x").alias("value"))


def block(tiles: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """A matrix of tiles set at (first row, first column)."""
    out = None
    for a, r, c in tiles:
        t = a.select((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), "value")
        out = t if out is None else out.unionByName(t)
    return canonical(out)


def diagonal_product(c: DataFrame, m: DataFrame) -> DataFrame:
    """(row, value): the diagonal of c times m, without the product."""
    right = m.select(F.col("row").alias("col"), F.col("col").alias("row"), F.col("value").alias("w"))
    return c.join(right, ["row", "col"]).groupBy("row").agg(F.sum(F.col("value") * F.col("w")).alias("value"))

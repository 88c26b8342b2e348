import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators.interpolate import RBFInterpolant, further_sites


def plane(x, y):
    return 4 + 3 * x + 2 * y


@pytest.fixture(scope="module")
def columns(spark):
    """Two columns of 40 sites, so far apart that the nearest 6 of any point lie in one of them."""
    i = F.col("id")
    return spark.range(80).select("id", (F.floor(i / 40) * 1.0).alias("x0"), (i % 40 / 400).alias("x1")).withColumn("d", plane(F.col("x0"), F.col("x1"))).withColumn("e", 1 - F.col("x0"))


def test_further_sites_are_the_first_that_add_rank():
    y = np.array([[0, 0.0], [0, 1], [0, 2], [0, 3], [1, 5], [2, 0]])
    assert further_sites(y, 3, 1) == [4] and further_sites(y[:4], 3, 1) is None
    assert further_sites(y[4:], 1, 0) == []


def test_values_from_neighbourhoods_on_a_line(spark, columns):
    at = spark.createDataFrame([(1, 0.1, 0.03), (2, 0.95, 0.05), (3, 0.3, 0.2)], "id long, x0 double, x1 double")
    got = {r.id: (r.d, r.e) for r in RBFInterpolant(columns, ["d", "e"], order=1, neighbors=6)(at).collect()}
    assert got.keys() == {1, 2, 3} and all(got[r.id] == pytest.approx((plane(r.x0, r.x1), 1 - r.x0), abs=1e-7) for r in at.collect())


def test_derivatives_from_neighbourhoods_on_a_line(spark, columns):
    at = spark.createDataFrame([(1, 0.1, 0.03), (2, 0.95, 0.05)], "id long, x0 double, x1 double")
    got = {r.id: r.d for r in RBFInterpolant(columns, order=1, neighbors=6)(at, (1, 0)).collect()}
    assert got == pytest.approx({1: 3, 2: 3}, abs=1e-7)
    with pytest.raises(ValueError, match="don't determine"):
        RBFInterpolant(columns.where("x0 = 0"), order=1, neighbors=6)(at).collect()

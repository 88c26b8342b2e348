import math

import pytest
from pyspark.sql import functions as F

from pointloom.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """90 embeddings of 4 components, so ids reach over 60, and 400 parts."""
    d = str(tmp_path_factory.mktemp("tables"))
    points = [(i, [math.sin(1.7 * i + k) for k in range(4)]) for i in range(90)]
    spark.createDataFrame(points, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    part = spark.range(1, 401).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), (900 + F.col("id") * 7919 % 1201).cast("double").alias("p_retailprice"))
    part.write.parquet(f"{d}/part.parquet")
    return d, {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}, part.collect()


FORMULAS = [(1, "ga", lambda x, y: -2 * x * math.exp(-x * x - y * y)), (1, "imq", lambda x, y: -x * (1 + x * x + y * y) ** -1.5), (2, "ga", lambda x, y: 4 * x * y * math.exp(-x * x - y * y)), (2, "phs3", lambda x, y: 3 * x * y / math.hypot(x, y))]


@pytest.mark.parametrize("order, name, formula", FORMULAS)
def test_derivatives_of_all_points(spark, tables, order, name, formula):
    d, x, _ = tables
    centers = {r.id: (r.x0, r.x1) for r in queries._centers(spark).collect()}
    got = {(r.i, r.j): r.value for r in queries.QUERIES[f"kernel_d{order}_{name}"](spark, d).collect()}
    want = {(i, j): formula(x[i][0] - c[0], x[i][1] - c[1]) for i in x for j, c in centers.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_fits_of_all_sites(spark, tables):
    d, x, part = tables
    want = {r.p_partkey: math.sin(3 * r.p_size / 50) + r.p_retailprice / 1000 for r in part}
    got = {r.id: r.d for r in queries.QUERIES["interp_at_sites"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    slopes = {r.id: r.d for r in queries.QUERIES["interp_local_derivative"](spark, d).collect()}
    assert slopes.keys() == x.keys() and all(abs(v - 3) < 2e-4 for v in slopes.values())

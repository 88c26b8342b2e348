import math
import random

import pytest
from pyspark.sql import functions as F

from pointloom.functions.formulation import Operator
from pointloom.operators import nodes, pairs
from pointloom.plans import queries
from pointloom.sources import points as P


def test_operator_algebra():
    dx, dy = Operator.derivative(1, 0), Operator.derivative(0, 1)
    assert (dx * dx + dy * dy).parts() == ([1.0, 1.0], [(2, 0), (0, 2)])
    assert ((dx + dy) * (dx - dy)).terms == {(2, 0): 1.0, (0, 2): -1.0} and (dx - dx).terms == {}
    assert (3 * dx).terms == {(1, 0): 3.0}


def test_boxes(spark):
    rng = random.Random(1)

    def boxes(n):
        out = []
        for i in range(n):
            x, y = rng.uniform(-2, 2), rng.uniform(-2, 2)
            out.append((i, x, y, x + rng.uniform(0, 0.7), y + rng.uniform(0, 0.7)))
        return out

    a, b = boxes(60), [*boxes(60), (60, -3.0, -3.0, 3.0, 3.0)]
    names = "id long, lo0 double, lo1 double, hi0 double, hi1 double"
    got = sorted(tuple(r) for r in pairs.box_join(spark.createDataFrame(a, names), spark.createDataFrame(b, names), 0.5).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


def test_normalizers(spark):
    dom = nodes.as_domain(spark, P.square())
    assert math.isclose(nodes.density_normalizer(spark, lambda x: F.lit(2.0), dom, 100, 5000), 50, rel_tol=0.05)
    assert math.isclose(nodes.max_normalizer(spark, lambda x: 4 * x[0], dom, 5000), 0.25, rel_tol=0.01)


def test_every_query_with_sql_is_registered():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) > 100


@pytest.mark.parametrize("name", ["kernel_phs2", "kernel_spwen31", "coo_add_rows", "contains_square", "interp_k1"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("supplier", "part", "lineitem", "embeddings"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = queries.QUERIES[name](spark, d)
    want = con.sql(queries.ORACLES[name]).fetchall()
    cols = [c[0] for c in con.sql(queries.ORACLES[name]).description]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.kernels import get_kernel
from pointloom.operators import pairs
from pointloom.plans import queries

GAP = lambda x: x[:, None] - x[None]
LENGTH = lambda x: 1 + abs(x) / 10
COVARIANCES = {
    "gp_derivative_covariance": lambda x: 2 * GAP(x) / 2.25 * np.exp(-GAP(x) ** 2 / 4.5),
    "gp_gibbs_covariance": lambda x: np.sqrt(2 * np.outer(LENGTH(x), LENGTH(x)) / (LENGTH(x)[:, None] ** 2 + LENGTH(x)[None] ** 2)) * np.exp(-GAP(x) ** 2 / (LENGTH(x)[:, None] ** 2 + LENGTH(x)[None] ** 2)),
    "gp_prior_covariance": lambda x: 2 * np.exp(-GAP(x) ** 2 / 4.5),
}
NAMES = [
    "gp_derivative_covariance",
    "gp_gibbs_covariance",
    "gp_prior_covariance",
    "kernel_exp",
    "kernel_imq",
    "kernel_ga",
    "kernel_iq",
    "kernel_mat32",
    "kernel_mat52",
    "kernel_mq",
    "kernel_phs1",
    "kernel_phs3",
    "kernel_phs4",
    "kernel_phs5",
    "kernel_phs6",
    "kernel_phs2",
    "kernel_phs7",
]
NUMBERED = [
    "gp_gibbs_covariance",
    "kernel_exp",
    "kernel_imq",
    "gp_prior_covariance",
    "kernel_ga",
    "kernel_iq",
    "kernel_mat32",
    "kernel_mat52",
    "kernel_mq",
    "kernel_phs1",
    "kernel_phs3",
    "kernel_phs2",
    "kernel_phs4",
    "kernel_phs5",
    "kernel_phs6",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """60 suppliers in one file."""
    d = str(tmp_path_factory.mktemp("tables"))
    t = spark.range(60).select(F.col("id").alias("s_suppkey"), (F.col("id") * 37 % 61 * 150.0 - 999).alias("s_acctbal"))
    t.coalesce(1).write.parquet(f"{d}/supplier.parquet")
    return d, np.array([r.s_acctbal for r in t.orderBy("s_suppkey").collect()]) / 1000


@pytest.mark.parametrize("name", NAMES)
def test_all_pairs_are_dealt_over_tasks(spark, tables, monkeypatch, name):
    d, x = tables
    monkeypatch.setattr(pairs, "SMALL", 10)
    monkeypatch.setattr(pairs, "PAIRS", 500, raising=False)
    got = queries.QUERIES[name](spark, d)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    kernel = COVARIANCES.get(name) or (lambda x: get_kernel(name.removeprefix("kernel_")).array(x[:, None], x[:, None], queries.EPS))
    want = kernel(x)
    assert len(rows) == 3600 == len({(r.i, r.j) for r in rows}) and max(abs(r.value - want[r.i, r.j]) for r in rows) < 6e-7
    assert len({r.task for r in rows}) == 8  # 3600 pairs, at most 500 planned for a task


@pytest.mark.parametrize("name", NUMBERED)
def test_many_pairs_are_numbered_not_joined(spark, tables, monkeypatch, name):
    d, x = tables
    monkeypatch.setattr(pairs, "PAIRS", 500)
    monkeypatch.setattr(pairs, "NUMBERED", 3600, raising=False)
    got = queries.QUERIES[name](spark, d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "POWER" not in plan.upper() and "Range" in plan
    kernel = COVARIANCES.get(name) or (lambda x: get_kernel(name.removeprefix("kernel_")).array(x[:, None], x[:, None], queries.EPS))
    want, rows = kernel(x), got.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 3600 == len({(r.i, r.j) for r in rows}) and max(abs(r.value - want[r.i, r.j]) for r in rows) < 6e-7
    assert len({r.task for r in rows}) == 8


#: Queries whose numbered pairs are made without a filter and whose distance on a line takes no root.
PLAIN = [
    "gp_gibbs_covariance",
    "kernel_imq",
    "gp_prior_covariance",
    "kernel_exp",
    "kernel_ga",
    "kernel_iq",
    "kernel_mat32",
    "kernel_mat52",
    "kernel_mq",
    "kernel_phs1",
    "kernel_phs3",
    "kernel_phs4",
    "kernel_phs5",
    "kernel_phs6",
    "kernel_phs2",
]


@pytest.mark.parametrize("name", PLAIN)
def test_numbered_pairs_take_no_filter_nor_shared_lists(spark, tables, monkeypatch, name):
    d, _ = tables
    monkeypatch.setattr(pairs, "NUMBERED", 3600)
    got = queries.QUERIES[name](spark, d)
    optimized = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in optimized and "SQRT(((ax0" not in optimized
    assert len(got.collect()) == 3600
    assert "ReusedSubquery" not in got._jdf.queryExecution().executedPlan().toString()


#: Queries whose numbered pairs are dealt so that files take little room.
NEAR = [
    "gp_prior_covariance",
    "kernel_exp",
    "kernel_iq",
    "kernel_mq",
    "kernel_phs3",
    "kernel_phs6",
    "gp_gibbs_covariance",
    "kernel_mat32",
    "kernel_phs2",
    "kernel_phs7",
    "kernel_ga",
    "kernel_mat52",
    "kernel_phs4",
    "gp_derivative_covariance",
    "kernel_imq",
    "kernel_phs1",
    "kernel_phs5",
]


@pytest.mark.parametrize("name", NEAR)
def test_numbered_pairs_of_a_task_are_near(spark, tables, monkeypatch, name):
    """A task's targets are of one strip of 10 neighbours on the line, or of two, and its centers are neighbours too."""
    d, x = tables
    monkeypatch.setattr(pairs, "PAIRS", 500)
    monkeypatch.setattr(pairs, "NUMBERED", 3600)
    rows = queries.QUERIES[name](spark, d).withColumn("task", F.spark_partition_id()).collect()
    place = np.argsort(np.argsort(x))
    assert len(rows) == 3600 == len({(r.i, r.j) for r in rows})
    tasks = [[(place[r.i], place[r.j]) for r in rows if r.task == t] for t in range(8)]
    one = [t for t in tasks if len({i // 10 for i, _ in t}) == 1]
    assert all(len({i // 10 for i, _ in t}) <= 2 for t in tasks) and len(one) == 4
    assert all(np.ptp([j for _, j in t]) <= 45 for t in one)


@pytest.mark.parametrize("sizes", [(0, 3), (3, 0), (1, 1), (5, 1), (1, 4), (4, 5)])
def test_numbered_pairs_of_unequal_sides(spark, monkeypatch, sizes):
    """A null and a NaN stay, a width by center too, and a side may be empty."""
    monkeypatch.setattr(pairs, "NUMBERED", 0, raising=False)
    values = [None, float("nan"), 0.5, -2.0, 1e9]
    a, b = (spark.createDataFrame([(10 * k, values[k], 1.0 + k) for k in range(n)], "id long, x0 double, w double") for n in sizes)
    got = pairs.all_pairs(a.select("id", "x0"), b, "imq", "w")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i in range(sizes[0]):
        for j in range(sizes[1]):
            none = values[i] is None or values[j] is None
            want[10 * i, 10 * j] = None if none else float(get_kernel("imq").array([[values[i]]], [[values[j]]], 1.0 + j)[0, 0])
    rows = {(r.i, r.j): r.value for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[k] is None if v is None else np.isclose(rows[k], v, equal_nan=True) for k, v in want.items())


def test_rounding_is_that_of_sql(spark):
    values = [0.5e-6, -0.5e-6, 1.5e-6, 2.675, -0.0, 1e300, float("inf"), None, 1234567.8912345]
    got = [r.v for r in queries.rounded(spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)).collect()]
    assert got == [1e-6, -1e-6, 2e-6, 2.675, 0.0, 1e300, float("inf"), None, 1234567.891235]

"""Named queries over the tables, and SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.functions.bsplines import basis_number, bspline, natural_knots
from pointloom.functions.expressions import ExpressionKernel
from pointloom.functions.formulation import Operator
from pointloom.functions.kernels import KERNELS, get_kernel
from pointloom.functions.polynomials import monomial_columns
from pointloom.operators import compact, factors, fd, fields, geometry, gp, interpolate, linalg, nodes, pairs, sparse
from pointloom.sources import points as P
from pointloom.sources.halton import HaltonSequence, halton, randint, uniform

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _round(c: str, digits: int):
    """Halves away from zero as SQL does it, in arithmetic of doubles: Spark's round goes by decimal text, at several times the cost of a kernel."""
    scale = 10.0**digits
    doubled = F.abs(c) * (scale * 2)
    near = F.signum(c) * (F.shiftright(F.floor(doubled) + 1, 1) / F.lit(scale))
    return F.when(doubled < 2.0**52, near).otherwise(F.col(c))  # beyond, doubles have no such digits; NaN stays


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Keys as they are, doubles rounded and without negative zero."""
    return df.select(*((_round(c, digits) + 0.0).alias(c) if c not in keys and t == "double" else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- point views

def suppliers(spark, d):
    """1-d points: account balances in thousands."""
    return P.as_points(P.table(spark, d, "supplier"), "s_suppkey", [F.col("s_acctbal") / 1000])


def parts(spark, d):
    """2-d sites: size and price, both scaled, one row for each place; d: a smooth function of the place."""
    t = P.table(spark, d, "part")
    return P.dedupe_sites(P.as_points(t, "p_partkey", [F.col("p_size") / 50, F.col("p_retailprice") / 1000]))


def lines(spark, d):
    """2-d cloud: quantity and price of line items."""
    t = P.table(spark, d, "lineitem")
    return P.as_points(t, F.col("l_orderkey") * 10 + F.col("l_linenumber"), [F.col("l_quantity") / 25 - 1, F.col("l_discount") * 20 - 1])


def flat(spark, d, n=2):
    """First components of the embeddings."""
    t = P.table(spark, d, "embeddings")
    return P.as_points(t, "vec_id", [F.col("embedding")[k].cast("double") for k in range(n)])


SUPPLIERS = "p AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x0 FROM supplier)"
PARTS = "p AS (SELECT min(p_partkey) AS id, x0, x1 FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS x0, p_retailprice / 1000 AS x1 FROM part) GROUP BY x0, x1)"
LINES = "p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 25 - 1 AS x0, l_discount * 20 - 1 AS x1 FROM lineitem)"
FLAT2 = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1 FROM embeddings)"
FLAT3 = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[3] AS DOUBLE) AS x2 FROM embeddings)"
R6 = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"

# ---------------------------------------------------------------- kernels

# The kernels' definitions in SQL: q is r * eps or r / eps.
PROFILES = {
    "phs1": "-q", "phs2": "q*q*ln(q)", "phs3": "q*q*q", "phs4": "-q*q*q*q*ln(q)", "phs5": "-q*q*q*q*q", "phs6": "q*q*q*q*q*q*ln(q)", "phs7": "q*q*q*q*q*q*q", "phs8": "-q*q*q*q*q*q*q*q*ln(q)",
    "mq": "-sqrt(1+q*q)", "imq": "1/sqrt(1+q*q)", "iq": "1/(1+q*q)", "ga": "exp(-q*q)", "exp": "exp(-q)", "se": "exp(-q*q/2)",
    "mat32": "(1+sqrt(3)*q)*exp(-sqrt(3)*q)", "mat52": "(1+sqrt(5)*q+5*q*q/3)*exp(-sqrt(5)*q)",
    "wen10": "greatest(1-q,0)", "wen11": "greatest(1-q,0)**3*(3*q+1)", "wen12": "greatest(1-q,0)**5*(8*q*q+5*q+1)", "wen30": "greatest(1-q,0)**2", "wen31": "greatest(1-q,0)**4*(4*q+1)", "wen32": "greatest(1-q,0)**6*(35*q*q+18*q+3)/3",
}
EPS = 0.7


def _kernel_query(name):
    k = get_kernel(name)
    q = f"(abs(a.x0 - b.x0) / {EPS})" if k.divides else f"(abs(a.x0 - b.x0) * {EPS})"
    profile = PROFILES[name.removeprefix("sp")].replace("q", "Q").replace("sQrt", "sqrt").replace("exp", "exp")
    profile = profile.replace("Q", q)
    if k.sparse:
        sql = f"WITH {SUPPLIERS} SELECT a.id AS i, b.id AS j, {R6(profile, 'value')} FROM p a JOIN p b ON abs(a.x0 - b.x0) <= {EPS}"
        return (lambda s, d: rounded(pairs.sparse_pairs(suppliers(s, d), suppliers(s, d), name, EPS))), sql
    zero = "CASE WHEN a.x0 = b.x0 THEN " + repr(k.center_value((0,))) + f" ELSE {profile} END"
    sql = f"WITH {SUPPLIERS} SELECT a.id AS i, b.id AS j, {R6(zero, 'value')} FROM p a, p b"
    return (lambda s, d: rounded(pairs.all_pairs(suppliers(s, d), suppliers(s, d), name, EPS))), sql


for _name in KERNELS:
    QUERIES[f"kernel_{_name}"], ORACLES[f"kernel_{_name}"] = _kernel_query(_name)

_D1 = {"phs3": "3*r*dx", "ga": "-2*dx*exp(-r*r)", "se": "-dx*exp(-r*r/2)", "mq": "-dx/sqrt(1+r*r)", "imq": "-dx*(1+r*r)**-1.5", "iq": "-2*dx*(1+r*r)**-2", "mat52": "-(5.0/3)*(1+sqrt(5)*r)*exp(-sqrt(5)*r)*dx", "wen31": "-20*greatest(1-r,0)**3*dx", "wen32": "-(56.0/3)*greatest(1-r,0)**5*(5*r+1)*dx"}
_D2 = {"phs3": "3*dx*dy/r", "phs5": "-15*r*dx*dy", "ga": "4*dx*dy*exp(-r*r)", "se": "dx*dy*exp(-r*r/2)", "mat52": "(25.0/3)*exp(-sqrt(5)*r)*dx*dy", "wen32": "560*greatest(1-r,0)**4*dx*dy"}


#: Centers that all points meet: the first of a Halton sequence, moved around the origin.
CENTERS = 64


def _centers(s):
    return halton(s, CENTERS, 2).select("id", (F.col("x0") - 0.5).alias("x0"), (F.col("x1") - 0.5).alias("x1"))


def _halton_sql(n: int, moved: float = 0.0) -> str:
    """Rows (id, x0, x1) of the first points of a Halton sequence in SQL."""
    return f"SELECT i AS id, {_inverse_sql('i + 1', 2)} - {moved} AS x0, {_inverse_sql('i + 1', 3)} - {moved} AS x1 FROM range({n}) t(i)"


def _inverse_sql(i: str, b: int) -> str:
    return " + ".join(f"CAST(({i}) // {b**k} % {b} AS DOUBLE) / {b**(k + 1)}" for k in range(math.ceil(14 / math.log2(b)) + 1))


def _derivative(name, diff, formula):
    pair = f"WITH {FLAT2}, c AS ({_halton_sql(CENTERS, 0.5)}), q AS (SELECT p.id AS i, c.id AS j, p.x0 - c.x0 AS dx, p.x1 - c.x1 AS dy, sqrt((p.x0-c.x0)*(p.x0-c.x0) + (p.x1-c.x1)*(p.x1-c.x1)) AS r FROM p, c)"
    QUERIES[f"kernel_d{sum(diff)}_{name}"] = lambda s, d: rounded(pairs.all_pairs(flat(s, d), _centers(s), name, 1.0, diff))
    ORACLES[f"kernel_d{sum(diff)}_{name}"] = f"{pair} SELECT i, j, {R6(formula, 'value')} FROM q"


for _name, _f in _D1.items():
    _derivative(_name, (1, 0), _f)
for _name, _f in _D2.items():
    _derivative(_name, (1, 1), _f)


_UNIT = "list_transform(range(64), lambda i: CAST(i = c.j AS DOUBLE))"


@query("kernel_64d", f"SELECT a.vec_id AS i, c.j, round(exp(-list_distance(CAST(a.embedding AS DOUBLE[]), {_UNIT}) / 2.0), 6) + 0.0 AS value FROM embeddings a, range(64) c(j)")
def kernel_64d(s, d):
    """All vectors against the unit vectors."""
    t = P.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    units = s.range(64).select("id", F.expr("transform(sequence(0, 63), i -> IF(i = id, 1D, 0D))").alias("x"))
    return rounded(pairs.array_pairs(t, units, "exp", 2.0))


@query("monomials_deg2", f"WITH {PARTS} SELECT id, 1.0 AS m0, {R6('x0', 'm1')}, {R6('x1', 'm2')}, {R6('x0*x0', 'm3')}, {R6('x0*x1', 'm4')}, {R6('x1*x1', 'm5')} FROM p".replace("1.0 AS m0", "CAST(1 AS DOUBLE) AS m0"))
def monomials_deg2(s, d):
    m = monomial_columns([F.col("x0"), F.col("x1")], 2)
    return rounded(parts(s, d).select("id", *(c.alias(f"m{i}") for i, c in enumerate(m))), "id")


@query("monomials_d1", f"WITH {PARTS} SELECT id, CAST(0 AS DOUBLE) AS m0, CAST(1 AS DOUBLE) AS m1, CAST(0 AS DOUBLE) AS m2, {R6('2*x0', 'm3')}, {R6('x1', 'm4')}, CAST(0 AS DOUBLE) AS m5 FROM p")
def monomials_d1(s, d):
    m = monomial_columns([F.col("x0"), F.col("x1")], 2, (1, 0))
    return rounded(parts(s, d).select("id", *(c.alias(f"m{i}") for i, c in enumerate(m))), "id")


# ---------------------------------------------------------------- sequences

@query("halton_2d", f"SELECT i AS id, {R6(_inverse_sql('i + 1', 2), 'x0')}, {R6(_inverse_sql('i + 1', 3), 'x1')} FROM range(2000) t(i)")
def halton_2d(s, d):
    return rounded(halton(s, 2000, 2), "id")


@query("halton_skip_start", f"SELECT i AS id, {R6(_inverse_sql('101 + 3 * i', 3), 'x0')}, {R6(_inverse_sql('101 + 3 * i', 5), 'x1')} FROM range(1000) t(i)")
def halton_skip_start(s, d):
    return rounded(halton(s, 1000, 2, start=100, skip=3, prime_index=1), "id")


@query("halton_randint", f"SELECT i AS id, CAST(floor(({_inverse_sql('i + 1', 2)}) * 7 + 3) AS BIGINT) AS x0 FROM range(500) t(i)")
def halton_randint(s, d):
    return randint(halton(s, 500), 3, 10)


@query("halton_uniform", f"SELECT i AS id, {R6(f'({_inverse_sql(chr(105) + " + 1", 2)}) * 6 - 2', 'x0')} FROM range(500) t(i)")
def halton_uniform(s, d):
    return rounded(uniform(halton(s, 500), [-2.0], [4.0]), "id")


@query("regular_grid", "SELECT i * 5 + j AS id, round(i / 3.0, 6) + 0.0 AS x0, round(-1 + j / 2.0, 6) + 0.0 AS x1 FROM range(4) a(i), range(5) b(j)")
def regular_grid(s, d):
    return rounded(P.grid(s, [0, -1], [1, 1], [4, 5]), "id")


# ---------------------------------------------------------------- joins of points

_D2SQL = "(a.x0-b.x0)*(a.x0-b.x0) + (a.x1-b.x1)*(a.x1-b.x1)"


@query("radius_join_2d", f"WITH {PARTS} SELECT a.id AS i, b.id AS j, {R6(_D2SQL, 'd2')} FROM p a JOIN p b ON {_D2SQL} <= 0.05 * 0.05")
def radius_join_2d(s, d):
    return rounded(pairs.radius_join(parts(s, d), parts(s, d), 0.05).select("i", "j", "d2"))


@query("knn_2d", f"WITH {FLAT2}, q AS (SELECT a.id AS i, row_number() OVER (PARTITION BY a.id ORDER BY {_D2SQL}, b.id) AS rank, b.id AS j, {R6(_D2SQL, 'd2')} FROM p a, p b) SELECT i, CAST(rank AS INTEGER) AS rank, j, d2 FROM q WHERE rank <= 5")
def knn_2d(s, d):
    return rounded(pairs.knn(flat(s, d), flat(s, d), 5))


@query("knn_2d_cells", f"WITH {FLAT2}, q AS (SELECT a.id AS i, row_number() OVER (PARTITION BY a.id ORDER BY {_D2SQL}, b.id) AS rank, b.id AS j, {R6(_D2SQL, 'd2')} FROM p a, p b) SELECT i, CAST(rank AS INTEGER) AS rank, j, d2 FROM q WHERE rank <= 5")
def knn_2d_cells(s, d):
    return rounded(pairs.knn(flat(s, d), flat(s, d), 5, brute_rows=0))


@query("nn_distance", f"WITH {FLAT2}, q AS (SELECT a.id AS i, b.id AS j, {_D2SQL} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2SQL}, b.id) AS k FROM p a JOIN p b ON a.id <> b.id) SELECT i, j, {R6('sqrt(d2)', 'distance')} FROM q WHERE k = 1")
def nn_distance(s, d):
    return rounded(pairs.nearest_distance(flat(s, d)))


@query("distinct_neighbourhoods", f"WITH {FLAT2}, q AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY {_D2SQL}, b.id) AS k FROM p a, p b), g AS (SELECT i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS key FROM q WHERE k <= 3 GROUP BY i) SELECT key, count(*) AS n FROM g GROUP BY key")
def distinct_neighbourhoods(s, d):
    sets, of = pairs.neighbourhoods(pairs.knn(flat(s, d), flat(s, d), 3))
    return of.join(sets, "key").groupBy("key").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sparse matrices

def _matrix(s, d):
    """Orders by suppliers: tax, repeated places as they come."""
    t = P.table(s, d, "lineitem")
    return t.select((F.col("l_partkey") % 50).alias("row"), F.col("l_suppkey").alias("col"), (F.col("l_tax") + 0.01).alias("value"))


_M = "m AS (SELECT l_partkey % 50 AS row, l_suppkey AS col, l_tax + 0.01 AS value FROM lineitem), c AS (SELECT row, col, sum(value) AS value FROM m GROUP BY row, col)"


@query("coo_canonical", f"WITH {_M} SELECT row, col, {R6('value', 'value')} FROM c")
def coo_canonical(s, d):
    return rounded(sparse.canonical(_matrix(s, d)), "row", "col")


@query("coo_row_norms_l1", f"WITH {_M} SELECT row, {R6('sum(abs(value))', 'norm')} FROM c GROUP BY row")
def coo_row_norms_l1(s, d):
    return rounded(sparse.row_norms(_matrix(s, d), 1), "row")


@query("coo_row_norms_l2", f"WITH {_M} SELECT row, {R6('sqrt(sum(value*value))', 'norm')} FROM c GROUP BY row")
def coo_row_norms_l2(s, d):
    return rounded(sparse.row_norms(_matrix(s, d)), "row")


@query("coo_divide_rows", f"WITH {_M} SELECT row, col, {R6('value / (row + 2.0)', 'value')} FROM c")
def coo_divide_rows(s, d):
    a = sparse.canonical(_matrix(s, d))
    x = s.range(50).select(F.col("id").alias("row"), (F.col("id") + 2.0).alias("x"))
    return rounded(sparse.divide_rows(a, x), "row", "col")


@query("coo_expand_rows", f"WITH {_M} SELECT row * 3 + 1 AS row, col, {R6('value', 'value')} FROM c")
def coo_expand_rows(s, d):
    places = s.range(50).select(F.col("id").alias("row"), (F.col("id") * 3 + 1).alias("new"))
    return rounded(sparse.expand_rows(sparse.canonical(_matrix(s, d)), places), "row", "col")


@query("coo_expand_cols", f"WITH {_M} SELECT row, col + 1000 AS col, {R6('value', 'value')} FROM c")
def coo_expand_cols(s, d):
    places = P.table(s, d, "supplier").select(F.col("s_suppkey").alias("col"), (F.col("s_suppkey") + 1000).alias("new"))
    return rounded(sparse.expand_cols(sparse.canonical(_matrix(s, d)), places), "row", "col")


@query("coo_add_rows", f"WITH {_M}, b AS (SELECT row, col, value FROM c UNION ALL SELECT 49 - row, col, value FROM c WHERE row < 20) SELECT row, col, {R6('sum(value)', 'value')} FROM b GROUP BY row, col")
def coo_add_rows(s, d):
    a = sparse.canonical(_matrix(s, d))
    places = s.range(20).select(F.col("id").alias("row"), (49 - F.col("id")).alias("new"))
    return rounded(sparse.add_rows(a, a, places), "row", "col")


@query("coo_matvec", f"WITH {_M} SELECT row, {R6('sum(value * sqrt(col))', 'value')} FROM c GROUP BY row")
def coo_matvec(s, d):
    x = P.table(s, d, "supplier").select(F.col("s_suppkey").alias("col"), F.sqrt("s_suppkey").alias("x"))
    return rounded(sparse.matvec(_matrix(s, d), x), "row")


@query("coo_matmul", f"WITH {_M} SELECT a.row AS row, b.row AS col, round(sum(a.value * b.value), 5) + 0.0 AS value FROM c a JOIN c b ON a.col = b.col GROUP BY a.row, b.row")
def coo_matmul(s, d):
    a = sparse.canonical(_matrix(s, d))
    return rounded(sparse.matmul(a, sparse.transpose(a)), "row", "col", digits=5)


@query("coo_diagonal_product", f"WITH {_M} SELECT row, {R6('sum(value * value)', 'value')} FROM c GROUP BY row")
def coo_diagonal_product(s, d):
    a = sparse.canonical(_matrix(s, d))
    return rounded(sparse.diagonal_product(a, sparse.transpose(a)), "row")


# ---------------------------------------------------------------- geometry

LSHAPE = ([[0, 0], [1, 0], [1, 0.5], [0.5, 0.5], [0.5, 1], [0, 1]], [[i, (i + 1) % 6] for i in range(6)])


def domain(s, shape) -> geometry.Domain:
    return geometry.Domain(*P.complex_frames(s, *shape))


@query("contains_square", f"WITH {FLAT2} SELECT id, x0 + 0.1 > 0 AND x0 + 0.1 < 1 AND x1 + 0.1 > 0 AND x1 + 0.1 < 1 AS inside FROM p")
def contains_square(s, d):
    moved = flat(s, d).select("id", (F.col("x0") + 0.1).alias("x0"), (F.col("x1") + 0.1).alias("x1"))
    return domain(s, P.square()).contains(moved).select("id", "inside")


@query("contains_lshape", f"WITH {LINES} SELECT id, (x0 + 1.003) / 2 < 1 AND (x1 + 1.003) / 2 < 1 AND NOT ((x0 + 1.003) / 2 > 0.5 AND (x1 + 1.003) / 2 > 0.5) AS inside FROM p")
def contains_lshape(s, d):
    moved = lines(s, d).select("id", ((F.col("x0") + 1.003) / 2).alias("x0"), ((F.col("x1") + 1.003) / 2).alias("x1"))
    return domain(s, LSHAPE).contains(moved).select("id", "inside")


@query("contains_cube", f"WITH {FLAT3} SELECT id, 3*x0+0.5 > 0 AND 3*x0+0.5 < 1 AND 3*x1+0.5 > 0 AND 3*x1+0.5 < 1 AND 3*x2+0.5 > 0 AND 3*x2+0.5 < 1 AS inside FROM p")
def contains_cube(s, d):
    moved = flat(s, d, 3).select("id", *((3 * F.col(f"x{k}") + 0.5).alias(f"x{k}") for k in range(3)))
    return domain(s, P.cube()).contains(moved).select("id", "inside")


@query("contains_circle_128", f"WITH {LINES}, t AS (SELECT id, x0 * 1.001 AS x, x1 * 1.001 AS y FROM p), e AS (SELECT cos(2*pi()*i/128) AS ax, sin(2*pi()*i/128) AS ay, cos(2*pi()*((i+1)%128)/128) AS bx, sin(2*pi()*((i+1)%128)/128) AS by_ FROM range(128) r(i)), u AS (SELECT DISTINCT x, y FROM t), k AS (SELECT u.x, u.y, count(*) AS n FROM u JOIN e ON (ay > y) <> (by_ > y) AND x < ax + (y - ay) * (bx - ax) / (by_ - ay) GROUP BY u.x, u.y) SELECT t.id, coalesce(k.n % 2 = 1, false) AS inside FROM t LEFT JOIN k ON k.x = t.x AND k.y = t.y")
def contains_circle_128(s, d):
    moved = lines(s, d).select("id", (F.col("x0") * 1.001).alias("x0"), (F.col("x1") * 1.001).alias("x1"))
    return domain(s, P.circle(5)).contains(moved).select("id", "inside")


@query("simplex_normals", "SELECT s_id, n0, n1 FROM (VALUES (0::BIGINT, 0.0::DOUBLE, -1.0::DOUBLE), (1, 1, 0), (2, 0, 1), (3, -1, 0)) t(s_id, n0, n1)")
def simplex_normals(s, d):
    return rounded(domain(s, P.square()).normals(), "s_id")


@query("polygon_area", "SELECT round(64 * sin(2 * pi() / 128), 6) + 0.0 AS volume")
def polygon_area(s, d):
    return rounded(domain(s, P.circle(5)).volume())


@query("cube_volume", "SELECT CAST(1 AS DOUBLE) AS volume")
def cube_volume(s, d):
    return rounded(domain(s, P.cube()).volume())


@query("sphere_volume", "SELECT round(4 * pi() / 3, 1) + 0.0 AS volume")
def sphere_volume(s, d):
    return rounded(domain(s, P.sphere(4)).volume(), digits=1)


@query("orient_square", "SELECT s_id, n0, n1 FROM (VALUES (0::BIGINT, 0.0::DOUBLE, -1.0::DOUBLE), (1, 1, 0), (2, 0, 1), (3, -1, 0)) t(s_id, n0, n1)")
def orient_square(s, d):
    v, smp = P.square()
    return rounded(domain(s, (v, [e[::-1] if i % 2 else e for i, e in enumerate(smp)])).oriented().normals(), "s_id")


def _segments(s, d):
    f = flat(s, d)
    return f.select("id", (F.col("x0") + 0.4).alias("a0"), (F.col("x1") + 0.4).alias("a1"), (F.col("x1") * 4 + 0.3).alias("b0"), (F.col("x0") * 4 + 0.7).alias("b1"))


_SEG = f"{FLAT2}, g AS (SELECT id, x0 + 0.4 AS a0, x1 + 0.4 AS a1, x1 * 4 + 0.3 AS b0, x0 * 4 + 0.7 AS b1 FROM p)"


@query("segment_crossings", f"WITH {_SEG} SELECT id, CAST(((a1 < 0) <> (b1 < 0) AND a0 + a1/(a1-b1)*(b0-a0) BETWEEN 0 AND 1) AS BIGINT) + CAST(((a1 < 1) <> (b1 < 1) AND a0 + (a1-1)/(a1-b1)*(b0-a0) BETWEEN 0 AND 1) AS BIGINT) + CAST(((a0 < 0) <> (b0 < 0) AND a1 + a0/(a0-b0)*(b1-a1) BETWEEN 0 AND 1) AS BIGINT) + CAST(((a0 < 1) <> (b0 < 1) AND a1 + (a0-1)/(a0-b0)*(b1-a1) BETWEEN 0 AND 1) AS BIGINT) AS count FROM g")
def segment_crossings(s, d):
    return domain(s, P.square()).intersection_count(_segments(s, d)).select("id", "count")


@query("first_hit", f"WITH {_SEG}, t AS (SELECT id, a0, a1, b0, b1, least(CASE WHEN b0 > 1 THEN (1-a0)/(b0-a0) WHEN b0 < 0 THEN a0/(a0-b0) ELSE 9 END, CASE WHEN b1 > 1 THEN (1-a1)/(b1-a1) WHEN b1 < 0 THEN a1/(a1-b1) ELSE 9 END) AS t FROM g WHERE a0 > 0 AND a0 < 1 AND a1 > 0 AND a1 < 1) SELECT id, CASE WHEN t <= 1 THEN {'round(a0 + t*(b0-a0), 6) + 0.0'} END AS h0, CASE WHEN t <= 1 THEN round(a1 + t*(b1-a1), 6) + 0.0 END AS h1 FROM t")
def first_hit(s, d):
    g = _segments(s, d).where("a0 > 0 AND a0 < 1 AND a1 > 0 AND a1 < 1")
    return rounded(domain(s, P.square()).first_hit(g).select("id", "h0", "h1"), "id")


@query("nearest_boundary", f"WITH {FLAT2}, e AS (SELECT id, x0 + 0.4 AS x, x1 + 0.4 AS y FROM p), c AS (SELECT id, x, y, greatest(least(x, 1), 0) AS cx, greatest(least(y, 1), 0) AS cy FROM e) SELECT id, {R6('CASE WHEN x > 0 AND x < 1 AND y > 0 AND y < 1 THEN least(x, 1-x, y, 1-y) ELSE sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) END', 'distance')} FROM c")
def nearest_boundary(s, d):
    moved = flat(s, d).select("id", (F.col("x0") + 0.4).alias("x0"), (F.col("x1") + 0.4).alias("x1"))
    return rounded(domain(s, P.square()).nearest(moved).select("id", "distance"), "id")


@query("nearest_cube", f"WITH {FLAT3}, e AS (SELECT id, 3*x0+0.5 AS x, 3*x1+0.5 AS y, 3*x2+0.5 AS z FROM p), c AS (SELECT *, greatest(least(x, 1), 0) AS cx, greatest(least(y, 1), 0) AS cy, greatest(least(z, 1), 0) AS cz FROM e) SELECT id, {R6('CASE WHEN x > 0 AND x < 1 AND y > 0 AND y < 1 AND z > 0 AND z < 1 THEN least(x, 1-x, y, 1-y, z, 1-z) ELSE sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) END', 'distance')} FROM c")
def nearest_cube(s, d):
    moved = flat(s, d, 3).select("id", *((3 * F.col(f"x{k}") + 0.5).alias(f"x{k}") for k in range(3)))
    return rounded(domain(s, P.cube()).nearest(moved).select("id", "distance"), "id")


def _cube_crossings_sql() -> str:
    """Crossings of a segment from (a0, a1, a2) to (b0, b1, b2) with the six faces."""
    faces = []
    for k in range(3):
        others = [j for j in range(3) if j != k]
        for at in (0, 1):
            t = f"((a{k} - {at}) / (a{k} - b{k}))"
            hits = " AND ".join(f"a{j} + {t} * (b{j} - a{j}) BETWEEN 0 AND 1" for j in others)
            faces.append(f"CASE WHEN (a{k} < {at}) <> (b{k} < {at}) AND {hits} THEN 1 ELSE 0 END")
    return f"WITH {FLAT3}, g AS (SELECT id, 2*x0+0.45 AS a0, 2*x1+0.47 AS a1, 2*x2+0.52 AS a2, 7*x1+0.61 AS b0, 7*x2+0.43 AS b1, 7*x0+0.57 AS b2 FROM p) SELECT id, CAST({' + '.join(faces)} AS BIGINT) AS count FROM g"


@query("cube_crossings", _cube_crossings_sql())
def cube_crossings(s, d):
    x = [F.col(f"x{k}") for k in range(3)]
    ends = [2 * x[0] + 0.45, 2 * x[1] + 0.47, 2 * x[2] + 0.52, 7 * x[1] + 0.61, 7 * x[2] + 0.43, 7 * x[0] + 0.57]
    segments = flat(s, d, 3).select("id", *(e.alias(n) for e, n in zip(ends, ("a0", "a1", "a2", "b0", "b1", "b2"), strict=True)))
    return domain(s, P.cube()).intersection_count(segments).select("id", "count")


@query("box_join_parts", f"WITH {PARTS} SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON a.x0 <= b.x0 + 0.01 AND b.x0 <= a.x0 + 0.01 AND a.x1 <= b.x1 + 0.02 AND b.x1 <= a.x1 + 0.02")
def box_join_parts(s, d):
    boxes = parts(s, d).select("id", F.col("x0").alias("lo0"), (F.col("x0") + 0.01).alias("hi0"), F.col("x1").alias("lo1"), (F.col("x1") + 0.02).alias("hi1"))
    return pairs.box_join(boxes, boxes, 0.03)


@query("bspline_hat", f"WITH {SUPPLIERS} SELECT id, {R6('greatest(0, least((x0 - 1) / 2, (6 - x0) / 3))', 'value')} FROM p")
def bspline_hat(s, d):
    return rounded(suppliers(s, d).select("id", bspline(F.col("x0"), [1.0, 3.0, 6.0], 0, 1).alias("value")), "id")


@query("snap_square", "WITH g AS (SELECT i * 11 + j AS id, 0.03 + i * 0.094 AS x, 0.05 + j * 0.09 AS y FROM range(11) a(i), range(11) b(j)) SELECT id, round(CASE WHEN x < 0.045 THEN 0 WHEN x > 0.955 THEN 1 ELSE x END, 6) + 0.0 AS x0, round(y, 6) + 0.0 AS x1 FROM g")
def snap_square(s, d):
    g = P.grid(s, [0.03, 0.05], [0.97, 0.95], [11, 11])
    return rounded(domain(s, P.square()).snap(g, 0.5).select("id", "x0", "x1"), "id")


# ---------------------------------------------------------------- interpolation

def _with_plane(points):
    return points.withColumn("d", 4 + 3 * F.col("x0") + 2 * F.col("x1"))


def _few_sites(s):
    """Sites of a global fit, scattered over the unit square."""
    return halton(s, 300, 2)


@query("interp_plane", f"WITH {FLAT2} SELECT id, {R6('4 + 3*x0 + 2*x1', 'd')} FROM p")
def interp_plane(s, d):
    return rounded(interpolate.RBFInterpolant(_with_plane(_few_sites(s)), phi="phs3", order=1, sigma=10.0)(flat(s, d)), "id")


@query("interp_derivative", f"WITH {FLAT2} SELECT id, CAST(3 AS DOUBLE) AS d FROM p")
def interp_derivative(s, d):
    return rounded(interpolate.RBFInterpolant(_with_plane(_few_sites(s)), phi="phs3", order=1)(flat(s, d), (1, 0)), "id", digits=4)


@query("interp_at_sites", f"WITH {PARTS} SELECT id, round(sin(x0 * 3) + x1, 5) + 0.0 AS d FROM p")
def interp_at_sites(s, d):
    """Local fits of all sites give the sites' own values."""
    sites = parts(s, d).withColumn("d", F.sin(F.col("x0") * 3) + F.col("x1"))
    return rounded(interpolate.RBFInterpolant(sites, phi="phs1", order=0, neighbors=20)(sites), "id", digits=5)


@query("interp_local_derivative", f"WITH {FLAT2} SELECT id, CAST(3 AS DOUBLE) AS d FROM p")
def interp_local_derivative(s, d):
    at = flat(s, d).select("id", (F.abs("x0") + 0.2).alias("x0"), (F.abs("x1") + 1).alias("x1"))
    return rounded(interpolate.RBFInterpolant(_with_plane(parts(s, d)), phi="phs3", order=1, neighbors=20)(at, (1, 0)), "id", digits=4)


@query("interp_local_plane", f"WITH {FLAT2} SELECT id, round(4 + 3*(abs(x0)+0.2) + 2*(abs(x1)+1), 4) + 0.0 AS d, round(1 - (abs(x0)+0.2), 4) + 0.0 AS e FROM p")
def interp_local_plane(s, d):
    sites = _with_plane(parts(s, d)).withColumn("e", 1 - F.col("x0"))
    at = flat(s, d).select("id", (F.abs("x0") + 0.2).alias("x0"), (F.abs("x1") + 1).alias("x1"))
    return rounded(interpolate.RBFInterpolant(sites, ["d", "e"], order=1, neighbors=20)(at), "id", digits=4)


@query("interp_k1", f"WITH {PARTS}, t AS (SELECT vec_id AS id, abs(CAST(embedding[1] AS DOUBLE)) + 0.2 AS y0, abs(CAST(embedding[2] AS DOUBLE)) + 1 AS y1 FROM embeddings), q AS (SELECT t.id, 4 + 3*x0 + 2*x1 AS d, row_number() OVER (PARTITION BY t.id ORDER BY (y0-x0)*(y0-x0)+(y1-x1)*(y1-x1), p.id) AS k FROM t, p) SELECT id, {R6('d', 'd')} FROM q WHERE k = 1")
def interp_k1(s, d):
    at = flat(s, d).select("id", (F.abs("x0") + 0.2).alias("x0"), (F.abs("x1") + 1).alias("x1"))
    return rounded(interpolate.RBFInterpolant(_with_plane(parts(s, d)), phi="phs1", order=0, neighbors=1)(at), "id")


def _grid(s):
    return s.range(40).select(((F.col("id") % 5 + 1) / 10).alias("sigma"), ((F.floor(F.col("id") / 5) + 1) * 21 / 10000).alias("eps"))


# With a compact kernel narrower than any gap, a fit of order 0 is the mean, so folds have closed forms. The key as a second coordinate
# leaves a gap between suppliers of the same balance too.
def _apart(s, d):
    return suppliers(s, d).select("id", "x0", F.col("id").cast("double").alias("x1"), F.sin("x0").alias("d"))


def _lined(s, d):
    """Suppliers along the line of their balances; those of the same balance lie on lines of their own, farther apart than any kernel of the grid reaches."""
    line = F.row_number().over(Window.partitionBy("x0").orderBy("id")) - 1
    return suppliers(s, d).select("id", "x0", line.cast("double").alias("x1"), F.sin("x0").alias("d"))


def _scores_sql(score: str) -> str:
    """Scores from the inverses of the whole kernel matrices, each by Gauss and Jordan for each run of sites that reach one another."""
    q = "(abs(x - y) / eps)"
    kernel = PROFILES["wen11"].replace("q", q) + " + CASE WHEN i = j THEN sigma * sigma ELSE 0 END"
    cleared = "CASE WHEN i = k THEN list_transform(r, lambda v, j: CASE WHEN j = k THEN 1 / v ELSE v / r[k] END) ELSE list_transform(r, lambda v, j: CASE WHEN j = k THEN -v / a[k][k] ELSE v - r[k] * a[k][j] / a[k][k] END) END"
    return f"""WITH RECURSIVE {SUPPLIERS}, v AS (SELECT id, x0, sin(x0) AS d, row_number() OVER (PARTITION BY x0 ORDER BY id) AS x1 FROM p),
        l AS (SELECT *, lag(x0) OVER (PARTITION BY x1 ORDER BY x0) AS before FROM v), g AS (SELECT CAST(i % 5 + 1 AS DOUBLE) / 10 AS sigma, CAST((i // 5 + 1) * 21 AS DOUBLE) / 10000 AS eps FROM range(40) t(i)),
        c AS (SELECT *, sum(CASE WHEN x0 - before < eps THEN 0 ELSE 1 END) OVER (PARTITION BY sigma, eps ORDER BY x1, x0) AS part FROM l, g),
        m AS (SELECT sigma, eps, part, list(x0 ORDER BY x0) AS xs, list(d ORDER BY x0) AS ds FROM c GROUP BY sigma, eps, part),
        e AS (SELECT sigma, eps, ds, 1 AS k, CAST(0 AS DOUBLE) AS size, list_transform(xs, lambda x, i: list_transform(xs, lambda y, j: {kernel})) AS a FROM m
            UNION ALL SELECT sigma, eps, ds, k + 1, size + ln(a[k][k]), list_transform(a, lambda r, i: {cleared}) FROM e WHERE k <= len(ds)),
        f AS (SELECT sigma, eps, ds, a, size FROM e WHERE k = len(ds) + 1),
        u AS (SELECT sigma, eps, d, list_sum(r) AS o, list_dot_product(r, ds) AS w, r[i] AS h FROM (SELECT sigma, eps, ds, unnest(ds) AS d, unnest(a) AS r, unnest(range(1, len(ds) + 1)) AS i FROM f)),
        t AS (SELECT sigma, eps, sum(o) AS schur, sum(w) / sum(o) AS mean, count(*) AS n FROM u GROUP BY sigma, eps), z AS (SELECT sigma, eps, sum(size) AS size FROM f GROUP BY sigma, eps)
        SELECT sigma, eps, {R6(score, 'score')} FROM u JOIN t USING (sigma, eps) JOIN z USING (sigma, eps) GROUP BY sigma, eps"""


@query("loocv_grid", _scores_sql("sqrt(sum(((w - o * mean) / (h - o * o / schur))**2))"))
def loocv_grid(s, d):
    return rounded(interpolate.parameter_scores(_lined(s, d), _grid(s), phi="wen11", order=0), "sigma", "eps")


@query("gml_grid", _scores_sql("sum(d * (w - o * mean)) * exp((any_value(size) + ln(any_value(schur)) - ln(any_value(n))) / (any_value(n) - 1))"))
def gml_grid(s, d):
    return rounded(interpolate.parameter_scores(_lined(s, d), _grid(s), phi="wen11", order=0, method="gml"), "sigma", "eps")


@query("cross_validate_means", f"WITH {SUPPLIERS}, v AS (SELECT sin(x0) AS d, (row_number() OVER (ORDER BY id) - 1) % 5 AS fold FROM p), k AS (SELECT f.fold, avg(v.d) AS m FROM (SELECT DISTINCT fold FROM v) f JOIN v ON v.fold <> f.fold GROUP BY f.fold) SELECT k.fold, round(sqrt(avg((v.d - k.m)**2)), 6) + 0.0 AS rmse FROM v JOIN k USING (fold) GROUP BY k.fold")
def cross_validate_means(s, d):
    return rounded(interpolate.cross_validate(_apart(s, d), 5, phi="wen11", eps=1e-9, order=0), "fold")


# ---------------------------------------------------------------- differentiation weights

@query("fd_plane_dx", f"WITH {FLAT2} SELECT id AS row, CAST(3 AS DOUBLE) AS value FROM p")
def fd_plane_dx(s, d):
    own = flat(s, d)
    w = fd.weight_matrix(own, own, 12, [(1, 0)])
    u = _with_plane(own).select(F.col("id").alias("col"), F.col("d").alias("x"))
    return rounded(sparse.matvec(w, u), "row", digits=4)


@query("fd_laplacian_quadratic", f"WITH {FLAT2} SELECT id AS row, CAST(6 AS DOUBLE) AS value FROM p")
def fd_laplacian_quadratic(s, d):
    own = flat(s, d)
    w = fd.weight_matrix(own, own, 15, [(2, 0), (0, 2)])
    u = own.select(F.col("id").alias("col"), (F.col("x0") * F.col("x0") + 2 * F.col("x1") * F.col("x1") + F.col("x0")).alias("x"))
    return rounded(sparse.matvec(w, u), "row", digits=3)


@query("fd_uniform_1d", "SELECT i AS row, j AS col, CASE WHEN abs(i - j) = 1 AND i BETWEEN 1 AND 8 THEN 1.0 WHEN i = j AND i BETWEEN 1 AND 8 THEN -2.0 WHEN i = 0 AND j = 1 THEN -2.0 WHEN i = 0 THEN 1.0 WHEN i = 9 AND j = 8 THEN -2.0 ELSE 1.0 END::DOUBLE AS value FROM range(10) a(i), range(10) b(j) WHERE abs(i - j) <= 1 OR (i = 0 AND j = 2) OR (i = 9 AND j = 7)")
def fd_uniform_1d(s, d):
    line = s.range(10).select("id", F.col("id").cast("double").alias("x0"))
    return rounded(fd.weight_matrix(line, line, 3, [(2,)]), "row", "col")


@query("fd_identity", f"WITH {FLAT2} SELECT id AS row, id AS col, CAST(1 AS DOUBLE) AS value FROM p")
def fd_identity(s, d):
    return rounded(fd.weight_matrix(flat(s, d), flat(s, d), 1, [(0, 0)]), "row", "col")


@query("elastic_rigid_motion", f"WITH {FLAT2} SELECT id AS row, t.c AS component, CAST(0 AS DOUBLE) AS value FROM p, (VALUES ('xx'), ('xy'), ('yx'), ('yy')) t(c)")
def elastic_rigid_motion(s, d):
    own = flat(s, d)
    ones = own.select(F.col("id").alias("col"), F.lit(1.0).alias("x"))
    out = None
    for name, m in fd.body_force(own, own, 15).items():
        r = sparse.matvec(m, ones).withColumn("component", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return rounded(out.select("row", "component", "value"), "row", "component", digits=2)


_FORCES = "SELECT id AS row, t.c AS component, t.v AS value FROM p, (VALUES {}) t(c, v)"


def _forces(matrices, field, digits):
    out = None
    for name, m in matrices.items():
        r = sparse.matvec(m, field).withColumn("component", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return rounded(out.select("row", "component", "value"), "row", "component", digits=digits)


@query("elastic_body_quadratic", f"WITH {FLAT2} " + _FORCES.format("('xx', 6.0::DOUBLE), ('xy', 2.0), ('yx', 2.0), ('yy', 2.0)"))
def elastic_body_quadratic(s, d):
    own = flat(s, d)
    field = own.select(F.col("id").alias("col"), (F.col("x0") * F.col("x0") + F.col("x0") * F.col("x1")).alias("x"))
    return _forces(fd.body_force(own, own, 15), field, 2)


@query("elastic_surface_plane", f"WITH {FLAT2} " + _FORCES.format("('xx', 7.0::DOUBLE), ('xy', 3.6), ('yx', 3.6), ('yy', 6.6)"))
def elastic_surface_plane(s, d):
    own = flat(s, d)
    field = _with_plane(own).select(F.col("id").alias("col"), F.col("d").alias("x"))
    at = own.withColumn("n0", F.lit(0.6)).withColumn("n1", F.lit(0.8))
    return _forces(fd.surface_force(at.select("id", "x0", "x1", "n0", "n1"), ["n0", "n1"], own, 12), field, 3)


@query("elastic_displacement", f"WITH {FLAT2} SELECT id AS row, t.c AS component, {R6('4 + 3*x0 + 2*x1', 'value')} FROM p, (VALUES ('xx'), ('yy')) t(c)")
def elastic_displacement(s, d):
    own = flat(s, d)
    return _forces(fd.displacement(own, own), _with_plane(own).select(F.col("id").alias("col"), F.col("d").alias("x")), 6)


@query("pde_poisson_manufactured", "SELECT i * 9 + j AS id, round((i/8.0)*(i/8.0) + 2*(j/8.0)*(j/8.0), 7) + 0.0 AS u FROM range(9) a(i), range(9) b(j)")
def pde_poisson_manufactured(s, d):
    g = P.grid(s, [0, 0], [1, 1], [9, 9])
    edge = (F.col("x0") == 0) | (F.col("x0") == 1) | (F.col("x1") == 0) | (F.col("x1") == 1)
    exact = F.col("x0") * F.col("x0") + 2 * F.col("x1") * F.col("x1")
    a = fd.weight_matrix(g.where(~edge), g, 13, [(2, 0), (0, 2)]).unionByName(fd.weight_matrix(g.where(edge), g, 1, [(0, 0)]))
    b = g.select(F.col("id").alias("row"), F.when(edge, exact).otherwise(6.0).alias("value"))
    u = linalg.solve_gathered(a, b)
    return rounded(u.select(F.col("row").alias("id"), F.col("x").alias("u")), "id", digits=7)


@query("cg_solve", "SELECT i AS row, round(sin(i), 4) + 0.0 AS x FROM range(30) t(i)")
def cg_solve(s, d):
    i = s.range(30)
    a = i.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(3.0).alias("value")).unionByName(i.where("id > 0").select(F.col("id").alias("row"), (F.col("id") - 1).alias("col"), F.lit(-1.0).alias("value"))).unionByName(i.where("id < 29").select(F.col("id").alias("row"), (F.col("id") + 1).alias("col"), F.lit(-1.0).alias("value")))
    b = sparse.matvec(a, i.select(F.col("id").alias("col"), F.sin("id").alias("x")))
    return rounded(linalg.cg(a, b), "row", digits=4)


# ---------------------------------------------------------------- Gaussian processes

def _daily(s, d):
    """Mean event value by type and day."""
    t = P.table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("d"))
    return t.select("event_type", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("bigint").alias("id"), F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double").alias("x0"), "d")


@query("gp_prior_covariance", f"WITH {SUPPLIERS} SELECT a.id AS i, b.id AS j, {R6('2.0*exp(-(a.x0-b.x0)*(a.x0-b.x0)/2/2.25)', 'value')} FROM p a, p b")
def gp_prior_covariance(s, d):
    return rounded(gp.prior_covariance(suppliers(s, d), suppliers(s, d), "se", 1.5, 2.0))


@query("gp_derivative_covariance", f"WITH {SUPPLIERS} SELECT a.id AS i, b.id AS j, {R6('2.0*(a.x0-b.x0)/2.25*exp(-(a.x0-b.x0)*(a.x0-b.x0)/2/2.25)', 'value')} FROM p a, p b")
def gp_derivative_covariance(s, d):
    return rounded(gp.prior_covariance(suppliers(s, d), suppliers(s, d), "se", 1.5, 2.0, (0,), (1,)))


@query("gp_one_observation", f"WITH {SUPPLIERS}, k AS (SELECT id, 2.0*exp(-(x0-1)*(x0-1)/2) AS k FROM p) SELECT id, {R6('k*3/(2+0.25)', 'mean')}, {R6('sqrt(2 - k*k/(2+0.25))', 'sd')} FROM k")
def gp_one_observation(s, d):
    return rounded(gp.gpiso("se", 1.0, 2.0).condition([[1.0]], [3.0], [0.5]).score(suppliers(s, d)), "id")


@query("gp_add_scale", f"WITH {SUPPLIERS}, k AS (SELECT id, 9*(2.0*exp(-(x0-1)*(x0-1)/2) + 0.5*exp(-abs(x0-1))) AS k FROM p) SELECT id, {R6('k*3/(22.5+0.25)', 'mean')}, {R6('sqrt(22.5 - k*k/(22.5+0.25))', 'sd')} FROM k")
def gp_add_scale(s, d):
    process = 3.0 * (gp.gpiso("se", 1.0, 2.0) + gp.gpiso("exp", 1.0, 0.5))
    return rounded(process.condition([[1.0]], [3.0], [0.5]).score(suppliers(s, d)), "id")


@query("gp_line_by_group", "WITH t AS (SELECT event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x, avg(value) AS d FROM events GROUP BY ALL), r AS (SELECT event_type, regr_slope(d, x) AS m, regr_intercept(d, x) AS c FROM t GROUP BY event_type) SELECT t.event_type, CAST(t.x AS BIGINT) AS id, round(c + m * t.x, 4) + 0.0 AS mean FROM t JOIN r USING (event_type)")
def gp_line_by_group(s, d):
    obs = _daily(s, d)
    return rounded(gp.score_groups(obs, obs.select("event_type", "id", "x0"), "event_type", lambda: gp.gppoly(1), sigma=1.0).select("event_type", "id", "mean"), "event_type", "id", digits=4)


@query("gp_mean_by_group", "WITH t AS (SELECT event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x, avg(value) AS d FROM events GROUP BY ALL), m AS (SELECT event_type, avg(d) AS m, count(*) AS n FROM t GROUP BY event_type) SELECT event_type, CAST(i AS BIGINT) AS id, round(m, 4) + 0.0 AS mean, round(sqrt(125.0 / n + 100), 4) + 0.0 AS sd FROM m, range(117) g(i)")
def gp_mean_by_group(s, d):
    """A constant with unknown value and noise, and a process so short that days don't tell of each other, at places between the days."""
    obs = _daily(s, d)
    at = obs.select("event_type").distinct().crossJoin(F.broadcast(P.grid(s, [0.5], [29.5], [117])))
    return rounded(gp.score_groups(obs, at.withColumn("x0", F.col("x0") + 0.0001), "event_type", lambda: gp.gpiso("wen11", 1e-6, 100.0) + gp.gppoly(0), sigma=5.0), "event_type", "id", digits=4)


@query("gp_loglik_diagonal", "SELECT round(-0.5 * sum(x*x/0.49 + ln(0.49) + ln(2*pi())), 4) + 0.0 AS value FROM (SELECT s_acctbal / 1000 AS x FROM supplier)")
def gp_loglik_diagonal(s, d):
    return rounded(gp.diagonal_log_likelihood(suppliers(s, d), F.col("x0"), F.lit(0.0), F.lit(0.49)), digits=4)


def _outlier_sql() -> str:
    rounds = ", ".join(f"c{k} AS (SELECT m, sqrt(avg((d - m)**2)) AS rms FROM v, (SELECT avg(d) AS m FROM v{f', c{k - 1} c WHERE abs(d - c.m) < 4 * c.rms' if k else ''}){f', c{k - 1} c WHERE abs(d - c.m) < 4 * c.rms' if k else ''} GROUP BY ALL)".replace("SELECT m, sqrt(avg((d - m)**2))", "SELECT x.m AS m, sqrt(avg((d - x.m)**2))").replace("FROM v)", "FROM v) x").replace("c.rms),", "c.rms) x,").replace("c.rms) GROUP", "c.rms) x GROUP") for k in range(8))
    return f"WITH {SUPPLIERS}, v AS (SELECT id, x0 + CASE WHEN (id - 1) % 25 = 0 THEN 60 ELSE 0 END AS d FROM p), {rounds} SELECT id, abs(d - m) >= 4 * rms AS outlier FROM v, c7"


@query("gp_outliers_constant", _outlier_sql())
def gp_outliers_constant(s, d):
    spiked = suppliers(s, d).select("id", (F.col("x0") + F.when((F.col("id") - 1) % 25 == 0, 60).otherwise(0)).alias("d"))
    return gp.constant_outliers(spiked, "d")


@query("gp_subtract", f"WITH {SUPPLIERS}, k AS (SELECT id, 2.0*exp(-(x0-1)*(x0-1)/2) + 0.5*exp(-abs(x0-1)) AS k FROM p) SELECT id, {R6('k*3/(2.5+0.25)', 'mean')}, {R6('sqrt(2.5 - k*k/(2.5+0.25))', 'sd')} FROM k")
def gp_subtract(s, d):
    process = gp.gpiso("se", 1.0, 2.0) - gp.gpiso("exp", 1.0, 0.5)
    return rounded(process.condition([[1.0]], [3.0], [0.5]).score(suppliers(s, d)), "id")


@query("gp_slope", f"WITH {SUPPLIERS}, k AS (SELECT id, -(x0-1)*2.0*exp(-(x0-1)*(x0-1)/2) AS k FROM p) SELECT id, {R6('k*3/2.25', 'mean')}, {R6('sqrt(2 - k*k/2.25)', 'sd')} FROM k")
def gp_slope(s, d):
    return rounded(gp.gpiso("se", 1.0, 2.0).condition([[1.0]], [3.0], [0.5]).differentiate((1,)).score(suppliers(s, d)), "id")


@query("gp_gibbs_covariance", f"WITH {SUPPLIERS}, l AS (SELECT id, x0, 1 + abs(x0) / 10 AS l FROM p) SELECT a.id AS i, b.id AS j, {R6('sqrt(2*a.l*b.l/(a.l*a.l+b.l*b.l))*exp(-(a.x0-b.x0)*(a.x0-b.x0)/(a.l*a.l+b.l*b.l))', 'value')} FROM l a, l b")
def gp_gibbs_covariance(s, d):
    return rounded(gp.gibbs_covariance(suppliers(s, d), suppliers(s, d), lambda x: 1 + F.abs(x) / 10, 1.0))


# ---------------------------------------------------------------- nodes

@query("rejection_sample", "SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS inside")
def rejection_sample(s, d):
    dom = domain(s, LSHAPE)
    got = nodes.rejection_sampling(s, 500, dom, lambda x: 0.5 + 0.5 * x[0])
    return dom.contains(got).agg(F.count("*").alias("n"), F.sum(F.col("inside").cast("bigint")).alias("inside"))


@query("poisson_disc_invariants", "SELECT true AS apart, true AS maximal, true AS inside")
def poisson_disc_invariants(s, d):
    dom = domain(s, P.square())
    got = nodes.poisson_discs(s, dom, lambda x: 0.05 + 0.05 * x[0], 0.05, 0.1)
    near = pairs.radius_join(got, got, 0.1).where("i < j").withColumn("r", F.greatest(0.05 + 0.05 * F.col("ax0"), 0.05 + 0.05 * F.col("bx0")))
    bad = near.where("d2 < r * r").count()
    # No place is farther from all discs' centers than its radius, but for the gaps between the candidates.
    places = P.grid(s, [0.01, 0.01], [0.99, 0.99], [50, 50])
    far = pairs.knn(places, got, 1).join(places, F.col("i") == F.col("id")).where("sqrt(d2) > 0.05 + 0.05 * x0 + 0.02").count()
    return dom.contains(got).agg(F.lit(bad == 0).alias("apart"), F.lit(far == 0).alias("maximal"), F.expr("bool_and(inside)").alias("inside"))


@query("disperse_invariants", "SELECT CAST(100 AS BIGINT) AS n, true AS inside, true AS wider")
def disperse_invariants(s, d):
    dom = domain(s, P.square())
    first = linalg._kept(nodes.rejection_sampling(s, 100, dom))
    then = nodes.disperse(first, dom, 3)
    gap = lambda df: pairs.nearest_distance(df).agg(F.min("distance")).first()[0]
    return dom.contains(then).agg(F.count("*").alias("n"), F.expr("bool_and(inside)").alias("inside"), F.lit(gap(then) >= gap(first)).alias("wider"))


@query("spacing_check", "SELECT CAST(122 AS BIGINT) AS n, CAST(2 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS sparse")
def spacing_check(s, d):
    g = P.grid(s, [0, 0], [1, 1], [11, 11])
    return nodes.check_spacing(g.unionByName(g.where("id = 3").withColumn("id", F.lit(500).cast("bigint"))))


@query("ghost_nodes", "WITH g AS (SELECT 0.03 + i * 0.094 AS x FROM range(11) a(i), range(11) b(j)), k AS (SELECT count(*) FILTER (x < 0.045 OR x > 0.955) AS edge, count(*) AS n FROM g) SELECT grp, n, normals FROM (SELECT 'boundary:all' AS grp, edge AS n, edge AS normals FROM k UNION ALL SELECT 'ghosts:all', edge, CAST(0 AS BIGINT) FROM k UNION ALL SELECT 'interior', n - edge, CAST(0 AS BIGINT) FROM k)")
def ghost_nodes(s, d):
    g = P.grid(s, [0.03, 0.05], [0.97, 0.95], [11, 11])
    made = nodes.prepare_nodes(g, domain(s, P.square()), iterations=0, boundary_groups={"all": None}, ghosts=["all"])
    return made.groupBy("grp").agg(F.count("*").alias("n"), F.count("n0").alias("normals"))


@query("monte_carlo_circle", "SELECT round(64 * sin(2 * pi() / 128), 1) + 0.0 AS integral")
def monte_carlo_circle(s, d):
    return rounded(nodes.monte_carlo(s, lambda x: F.lit(1.0), [-1, -1], [1, 1], 20000, domain(s, P.circle(5))).select("integral"), digits=1)


# ---------------------------------------------------------------- kernels by text, factors, compact fits, fields

_PAIR2 = f"WITH {FLAT2}, c AS ({_halton_sql(CENTERS, 0.5)}), q AS (SELECT p.id AS i, c.id AS j, p.x0 - c.x0 AS dx, p.x1 - c.x1 AS dy, (p.x0-c.x0)*(p.x0-c.x0) + (p.x1-c.x1)*(p.x1-c.x1) AS r2 FROM p, c) "


def _expression():
    return ExpressionKernel("exp(-(eps*r)**2) * (1 + (eps*r)**2)")


@query("expression_d1", _PAIR2 + f"SELECT i, j, {R6('-2*r2*exp(-r2)*dx', 'value')} FROM q")
def expression_d1(s, d):
    return rounded(pairs.all_pairs(flat(s, d), _centers(s), _expression(), 1.0, (1, 0)), "i", "j")


@query("expression_d2", _PAIR2 + f"SELECT i, j, {R6('4*(r2-1)*exp(-r2)*dx*dy', 'value')} FROM q")
def expression_d2(s, d):
    return rounded(pairs.all_pairs(flat(s, d), _centers(s), _expression(), 1.0, (1, 1)), "i", "j")


def _tridiagonal(s, n, below=-1.0, middle=3.0, above=-1.0):
    i = s.range(n).withColumnRenamed("id", "row")
    at = lambda k, v: i.where(F.col("row") + k >= 0).where(F.col("row") + k < n).select("row", (F.col("row") + k).alias("col"), F.lit(v).alias("value"))
    return at(-1, below).unionByName(at(0, middle)).unionByName(at(1, above))


def _right(s, a, n):
    return sparse.matvec(a, s.range(n).select(F.col("id").alias("col"), F.sin("id").alias("x")))


@query("sparse_solve", "SELECT i AS row, round(sin(i), 6) + 0.0 AS x FROM range(2000) t(i)")
def sparse_solve(s, d):
    a = _tridiagonal(s, 2000, below=-0.5)
    return rounded(factors.solve_sparse(a, _right(s, a, 2000)), "row")


@query("sparse_posdef_solve", "SELECT i AS row, round(sin(i), 6) + 0.0 AS x FROM range(2000) t(i)")
def sparse_posdef_solve(s, d):
    a = _tridiagonal(s, 2000)
    return rounded(factors.solve_sparse(a, _right(s, a, 2000), positive=True), "row")


@query("sparse_log_det", "SELECT round(301 * ln((3 + sqrt(5)) / 2) - ln(sqrt(5)), 6) + 0.0 AS value")
def sparse_log_det(s, d):
    return rounded(s.createDataFrame([(factors.log_determinant(_tridiagonal(s, 300)),)], "value double"))


@query("gmres_solve", "SELECT i AS row, round(sin(i), 4) + 0.0 AS x FROM range(6) t(i)")
def gmres_solve(s, d):
    a = _tridiagonal(s, 6, below=-0.5)
    return rounded(linalg.gmres(a, _right(s, a, 6)), "row", digits=4)


@query("compact_at_sites", f"WITH {FLAT2} SELECT id, round(sin(3*x0) + x1, 5) + 0.0 AS d FROM p")
def compact_at_sites(s, d):
    own = flat(s, d).withColumn("d", F.sin(3 * F.col("x0")) + F.col("x1"))
    return rounded(compact.CompactInterpolant(own, phi="spwen30", eps=0.1, order=1)(own), "id", digits=5)


@query("compact_plane_slope", f"WITH {FLAT2} SELECT id, CAST(3 AS DOUBLE) AS d FROM p")
def compact_plane_slope(s, d):
    own = _with_plane(flat(s, d))
    return rounded(compact.CompactInterpolant(own, phi="spwen31", eps=0.1, order=1, sigma=0.1)(own, (1, 0)), "id", digits=5)


@query("collocation_poisson", f"WITH {FLAT2} SELECT id, {R6('x0*x0 + 2*x1*x1', 'd')} FROM p")
def collocation_poisson(s, d):
    """On a square around all points: the Laplacian inside, values on the border."""
    g = P.grid(s, [-1, -1], [1, 1], [9, 9])
    edge = F.greatest(F.abs("x0"), F.abs("x1")) > 0.99
    inner, outer = g.where(~edge).withColumn("d", F.lit(6.0)), g.where(edge).withColumn("d", F.col("x0") * F.col("x0") + 2 * F.col("x1") * F.col("x1"))
    fit = fields.Collocation([(inner, Operator.laplacian(2)), (outer, Operator.derivative(0, 0))], "phs5", order=3)
    return rounded(fit(flat(s, d)), "id")


@query("rk4_decay", f"WITH {SUPPLIERS} SELECT id AS row, {R6('x0 * power(1 - 0.2 + 0.02 - 0.008/6 + 0.0016/24, 3)', 'x')} FROM p")
def rk4_decay(s, d):
    p = suppliers(s, d).select(F.col("id").alias("row"), F.col("x0").alias("x"))
    decay = sparse.diagonal(p.select("row", F.lit(-1.0).alias("x")))
    slope = lambda u: sparse.matvec(decay, u.withColumnRenamed("row", "col")).withColumnRenamed("value", "x")
    return rounded(fields.rk4(slope, p, 0.2, 3), "row")


@query("low_pass_line", "WITH t AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x, avg(value) AS d FROM events GROUP BY ALL), r AS (SELECT regr_slope(d, x) AS m, regr_intercept(d, x) AS c FROM t) SELECT CAST(x AS BIGINT) AS id, round(c + m * x, 2) + 0.0 AS mean FROM t, r")
def low_pass_line(s, d):
    """So low a cutoff that a line is left of the daily means."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    t = P.table(s, d, "events").groupBy(day.cast("bigint").alias("id")).agg(F.avg("value").alias("d")).withColumn("x0", F.col("id").cast("double"))
    return rounded(fields.low_pass(t, cutoff=1e-3, n=3).select("id", "mean"), "id", digits=2)


@query("recursive_integral", "SELECT round(CAST(0.25 AS DOUBLE), 2) AS integral")
def recursive_integral(s, d):
    return rounded(fields.recursive_monte_carlo(s, lambda x: x[0] * x[1], [0, 0], [1, 1], samples=400, tolerance=2e-3).select("integral"), digits=2)


@query("hyperviscosity_quartic", "SELECT CAST(i AS BIGINT) AS row, CAST(-32 AS DOUBLE) AS value FROM range(144) t(i)")
def hyperviscosity_quartic(s, d):
    g = P.grid(s, [0, 0], [1, 1], [12, 12])
    u = g.select(F.col("id").alias("col"), (F.pow("x0", F.lit(4.0)) + F.col("x0") * F.col("x0") * F.col("x1") * F.col("x1")).alias("x"))
    return rounded(sparse.matvec(fields.hyperviscosity(g, 30, 2, phi="phs5"), u), "row", digits=3)


@query("fd_variable_coefficient", f"WITH {FLAT2} SELECT id AS row, round(3*x0 - 2, 4) + 0.0 AS value FROM p")
def fd_variable_coefficient(s, d):
    own = flat(s, d)
    coefficients, diffs = (Operator.derivative(1, 0) * F.col("x0") - Operator.derivative(0, 1)).parts()
    u = _with_plane(own).select(F.col("id").alias("col"), F.col("d").alias("x"))
    return rounded(sparse.matvec(fd.weight_matrix(own, own, 12, diffs, coefficients), u), "row", digits=4)


@query("elastic_body_3d", f"WITH {FLAT3} " + _FORCES.format("('xx', 6.0::DOUBLE), ('xy', 2.0), ('xz', 0.0), ('yx', 2.0), ('yy', 2.0), ('yz', 0.0), ('zx', 0.0), ('zy', 0.0), ('zz', 2.0)"))
def elastic_body_3d(s, d):
    own = flat(s, d, 3)
    field = own.select(F.col("id").alias("col"), (F.col("x0") * F.col("x0") + F.col("x0") * F.col("x1")).alias("x"))
    return _forces(fd.body_force(own, own, 30), field, 2)


# ---------------------------------------------------------------- predicates, orders, splines

@query("orthogonal_3d", f"WITH {FLAT3}, q AS (SELECT id, CASE WHEN abs(x0) <= abs(x1) AND abs(x0) <= abs(x2) THEN [0.0, x2, -x1] WHEN abs(x1) <= abs(x2) THEN [-x2, 0.0, x0] ELSE [x1, -x0, 0.0] END AS w FROM p) SELECT id, " + ", ".join(R6(f"w[{k + 1}] / sqrt(w[1]*w[1] + w[2]*w[2] + w[3]*w[3])", f"w{k}") for k in range(3)) + " FROM q")
def orthogonal_3d(s, d):
    w = geometry.orthogonal([F.col(f"x{k}") for k in range(3)])
    return rounded(flat(s, d, 3).select("id", *(c.alias(f"w{k}") for k, c in enumerate(w))), "id")


@query("in_triangle", f"WITH {FLAT3} SELECT id, x0 >= -0.5 AND x1 >= -0.5 AND x0 + x1 <= 0 AS inside, (x0 + 0.1) * 0.2 + (x1 - 0.1) * 0.4 BETWEEN 0 AND 0.2 AS beside FROM p")
def in_triangle(s, d):
    p, n = [F.col(f"x{k}") for k in range(3)], lambda *v: [F.lit(float(c)) for c in v]
    inside = geometry.in_triangle(p, n(-0.5, -0.5, 0), n(0.5, -0.5, 0), n(-0.5, 0.5, 0))
    return flat(s, d, 3).select("id", inside.alias("inside"), geometry.in_segment(p[:2], n(-0.1, 0.1), n(0.1, 0.5)).alias("beside"))


@query("neighbor_order_path", "SELECT i * 37 % 101 AS id, least(i, 100 - i) // 2 AS from_end FROM range(101) t(i)")
def neighbor_order_path(s, d):
    """Nodes of a line, with mixed ids: the order follows the line from one end to the other (at the ends two nodes may change places)."""
    line = s.range(101).select((F.col("id") * 37 % 101).alias("id"), F.col("id").cast("double").alias("x0"))
    return nodes.neighbor_order(line, 3).select("id", F.floor(F.least("place", 100 - F.col("place")) / 2).alias("from_end"))


@query("curve_order", f"WITH {SUPPLIERS}, b AS (SELECT min(x0) AS lo, max(x0) - min(x0) AS w FROM p) SELECT row_number() OVER (ORDER BY floor((x0 - lo) / w * 65535), p.id) - 1 AS id, x0 FROM p, b")
def curve_order(s, d):
    return nodes.reordered(suppliers(s, d))


@query("group_indices", f"WITH {SUPPLIERS} SELECT CASE WHEN x0 < 0 THEN 'below' ELSE 'above' END AS grp, string_agg(id, ',' ORDER BY id) AS ids FROM p GROUP BY 1")
def group_indices(s, d):
    marked = suppliers(s, d).withColumn("grp", F.when(F.col("x0") < 0, "below").otherwise("above"))
    return nodes.group_indices(marked).select("grp", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("halton_sequence_parts", f"SELECT id, {R6('x0', 'x0')}, {R6('x1', 'x1')} FROM ({_halton_sql(500)})")
def halton_sequence_parts(s, d):
    h = HaltonSequence(s, 2)
    first, then = h.random(200), h.random(300)
    return rounded(first.unionByName(then.withColumn("id", F.col("id") + 200)), "id")


@query("natural_splines", f"WITH {SUPPLIERS} SELECT id, CAST(1 AS DOUBLE) AS total, {R6('(x0 + 2) / 14', 'line')} FROM p")
def natural_splines(s, d):
    """Splines add up to 1, and weighted by the means of their inner knots, to their argument."""
    knots = natural_knots(9, 3)
    x = (F.col("x0") + 2) / 14
    own = [(bspline(x, knots, k, 3), sum(knots[k + 1 : k + 4]) / 3) for k in range(basis_number(knots, 3))]
    return rounded(suppliers(s, d).select("id", sum((b for b, _ in own), F.lit(0.0)).alias("total"), sum((b * m for b, m in own), F.lit(0.0)).alias("line")), "id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Prices at sizes nobody offers, from the 20 nearest offers: local interpolation with smoothing."""
    t = P.table(spark, d, "part")
    sites = P.as_points(t, "p_partkey", [F.col("p_size") / 50], d=F.col("p_retailprice"))
    at = P.grid(spark, [0.02], [1.0], [99])
    return rounded(interpolate.RBFInterpolant(P.dedupe_sites(sites), phi="phs3", order=1, sigma=1.0, neighbors=20)(at), "id")

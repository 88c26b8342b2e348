"""Joins of point sets: all pairs, pairs within a radius, nearest neighbours.

Points are id and x0..; results name the two ids i and j. Radius and neighbour joins put points into grid cells and join cells by
equality, so work follows the number of near pairs; small sides are broadcast only after their rows are counted.
"""

import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pointloom.functions.kernels import get_kernel
from pointloom.sources.points import coordinates

#: Rows up to which a side is broadcast.
SMALL = 50_000
#: Targets of a cell that one task of a radius join takes.
HOT = 4096
#: Centers up to which all pairs broadcast them, and pairs that one task makes.
CENTERS, PAIRS = 1_000_000, 5_000_000
#: Pairs from which all pairs are numbered and their points looked up, and rows of either side up to which they are.
NUMBERED, GATHERED = 50_000_000, 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))


def _renamed(df: DataFrame, ident: str, mark: str, keep=()) -> DataFrame:
    return df.select(F.col("id").alias(ident), *(F.col(c).alias(mark + c) for c in coordinates(df)), *keep)


def _crossed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a with every row of b; a is dealt anew where its tasks would make too many pairs, as small files are one task."""
    n = b.limit(CENTERS + 1).count()
    if n > CENTERS:
        return a.crossJoin(b)
    m = a.count()
    tasks = math.ceil(m * n / PAIRS)
    if m * n >= NUMBERED and max(m, n) <= GATHERED and {t for _, t in a.dtypes + b.dtypes} <= {"bigint", "double"}:
        return _numbered(a, b, tasks)
    return (a.repartition(tasks) if tasks > 1 else a).crossJoin(F.broadcast(b))


def _numbered(a: DataFrame, b: DataFrame, tasks: int) -> DataFrame:
    """All pairs as a range of numbers that index a and b; a join copies each row it makes, a range doesn't.

    Both sides are sorted by their points, and the targets dealt in strips under half as high as a task's square, so that values repeat early in a file: a task has near targets and near
    centers, so few gaps and few values among many pairs, which files with dictionaries store in a fraction of the room.
    """
    spark, x, y = a.sparkSession, *(t.sort_by([(c, "ascending") for c in [*t.column_names[1:], t.column_names[0]]]) for t in (a.toArrow(), b.toArrow()))
    m, n = max(x.num_rows, 1), max(y.num_rows, 1)
    high = math.ceil(m / math.ceil(m / max(math.isqrt(PAIRS // 5), 1)))

    def looked_up(t: pa.Table, at: Column, spare: int) -> list[Column]:
        # One frame for each list: as fields of one row they would be unpacked anew for each pair. Only lists with nulls are asked for them.
        lists = []
        for c in t.column_names:
            values = pa.concat_arrays(t[c].chunks or [pa.array([], t[c].type)])
            values = pa.concat_arrays([values, values.slice(0, spare)])
            kind = ArrayType(DoubleType() if pa.types.is_floating(values.type) else LongType(), values.null_count > 0)
            rows = pa.table({c: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)})
            lists.append(spark.createDataFrame(rows, StructType([StructField(c, kind)])).scalar()[at].alias(c))
        return lists

    # b's lists are longer by one that is never looked up: were they equal to a's, the list would be stored in a field anew for each pair.
    numbers = spark.range(0, x.num_rows * y.num_rows, 1, max(tasks, 1))
    strip, rest = f"int(id div {high * n}L)", f"int(id % {high * n}L)"
    height = f"{high}" if m % high == 0 else f"least({high}, {m} - {high} * {strip})"
    return numbers.select(*looked_up(x, F.expr(f"{high} * {strip} + {rest} % {height}"), 0), *looked_up(y, F.expr(f"int({rest} div {height})"), 1))


def all_pairs(targets: DataFrame, centers: DataFrame, kernel, eps=1.0, diff=None) -> DataFrame:
    """(i, j, value): the kernel matrix of a stated set of centers; eps may name a column of centers."""
    k, named = get_kernel(kernel) if isinstance(kernel, str) else kernel, isinstance(eps, str)
    a, b = _renamed(targets, "i", "a"), _renamed(centers, "j", "b", [F.col(eps).alias("eps")] if named else [])
    d = [F.col("a" + c) - F.col("b" + c) for c in coordinates(targets)]
    e = F.col("eps") if named else eps
    return _crossed(a, b).select("i", "j", (k.column(d, e, diff) + 0.0).alias("value"))


def all_pairs_of(targets: DataFrame, centers: DataFrame) -> DataFrame:
    """(i, j, ax.., bx..): all targets with a stated set of centers."""
    return _crossed(_renamed(targets, "i", "a"), _renamed(centers, "j", "b"))


def array_pairs(targets: DataFrame, centers: DataFrame, kernel, eps: float = 1.0) -> DataFrame:
    """(i, j, value) for points in an array column x of any dimension."""
    k = get_kernel(kernel) if isinstance(kernel, str) else kernel
    a, b = targets.select(F.col("id").alias("i"), F.col("x").alias("a")), centers.select(F.col("id").alias("j"), F.col("x").alias("b"))
    r = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return _crossed(a, b).withColumn("r", r).select("i", "j", k.column([F.col("r")], eps).alias("value"))


def _cells(df: DataFrame, names: list[str], width: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(width)).cast("bigint") for c in names]


def _lanes(points: DataFrame, cells: list[str], hot: int) -> DataFrame | None:
    """(cells.., lanes) of cells that hold over hot points, so many that each lane has hot of them; None if there is no such cell."""
    from pointloom.operators.linalg import _kept

    found = points.groupBy(*cells).agg(F.count("*").alias("n")).where(F.col("n") > hot)
    if found.limit(1).count() == 0:
        return None
    return small(_kept(found.select(*cells, F.ceil(F.col("n") / hot).cast("int").alias("lanes"))))


def radius_join(targets: DataFrame, sources: DataFrame, radius: float, keep=(), hot: int = HOT) -> DataFrame:
    """(i, j, d2, ax.., bx..) of all pairs at most radius apart, and columns of sources to keep.

    The targets of a cell with over hot of them are dealt over lanes, and the sources near it go to each lane.
    """
    x = coordinates(targets)
    a, b = _renamed(targets, "i", "a"), _renamed(sources, "j", "b", keep)
    cells = [f"c{k}" for k in range(len(x))]
    offsets = list(itertools.product((-1, 0, 1), repeat=len(x)))
    a = a.select("*", *(c.alias(k) for k, c in zip(cells, _cells(a, ["a" + c for c in x], radius), strict=True)))
    b = b.select("*", F.explode(F.array(*(F.struct(*(F.lit(o).cast("bigint").alias(f"o{k}") for k, o in enumerate(off))) for off in offsets))).alias("o"))
    b = b.select("j", *("b" + c for c in x), *keep, *((c + F.col(f"o.o{k}")).alias(f"c{k}") for k, c in enumerate(_cells(b, ["b" + c for c in x], radius))))
    lanes = _lanes(a, cells, hot)
    if lanes is not None:
        a = a.join(lanes, cells, "left").withColumn("lane", F.coalesce(F.pmod(F.xxhash64("i"), "lanes").cast("int"), F.lit(0))).drop("lanes")
        b = b.join(lanes, cells, "left").withColumn("lane", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("lanes") - 1, F.lit(0))))).drop("lanes")
        cells.append("lane")
    d2 = squared_distance([F.col("a" + c) for c in x], [F.col("b" + c) for c in x])
    joined = a.join(b, cells).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return joined.select("i", "j", "d2", *("a" + c for c in x), *("b" + c for c in x), *keep)


def sparse_pairs(targets: DataFrame, centers: DataFrame, kernel, eps: float = 1.0, diff=None) -> DataFrame:
    """(i, j, value) of a compact kernel, only for pairs within its support."""
    k = get_kernel(kernel) if isinstance(kernel, str) else kernel
    near = radius_join(targets, centers, k.supp * eps)
    return near.select("i", "j", (k.column([F.col("a" + c) - F.col("b" + c) for c in coordinates(targets)], eps, diff) + 0.0).alias("value"))


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy("d2", "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(targets: DataFrame, sources: DataFrame, k: int, exclude_self: bool = False, brute_rows: int = 2000) -> DataFrame:
    """(i, rank, j, d2) of the k nearest sources, ties to the smaller id. ValueError if there are fewer than k.

    Up to brute_rows sources are compared directly. More go into cells holding about 2 k points each: a target with k sources within a
    cell's width among the neighbouring cells is done; for the others the width doubles.
    """
    x = coordinates(targets)
    box = sources.agg(F.count("*").alias("n"), *(F.min(c).alias("lo" + c) for c in x), *(F.max(c).alias("hi" + c) for c in x)).first()
    if box.n < k + exclude_self:
        raise ValueError(f"{k} neighbours asked of {box.n} points")
    other = F.col("i") != F.col("j") if exclude_self else F.lit(True)
    if box.n <= brute_rows:
        a, b = _renamed(targets, "i", "a"), _renamed(sources, "j", "b")
        d2 = squared_distance([F.col("a" + c) for c in x], [F.col("b" + c) for c in x])
        return _ranked(a.crossJoin(F.broadcast(b)).where(other).select("i", "j", d2.alias("d2")), k).select("i", "rank", "j", "d2")
    spans = [box["hi" + c] - box["lo" + c] for c in x]
    volume = math.prod(s for s in spans if s > 0) or 1.0
    width = (volume * 2 * k / box.n) ** (1 / max(1, sum(s > 0 for s in spans)))
    outer = targets.agg(*(F.min(c).alias("lo" + c) for c in x), *(F.max(c).alias("hi" + c) for c in x)).first()
    reach = math.sqrt(sum((max(box["hi" + c], outer["hi" + c] or 0) - min(box["lo" + c], outer["lo" + c] or 0)) ** 2 for c in x))
    from pointloom.operators.linalg import _kept

    done, left = None, targets.select("id", *x)
    while True:
        near = _kept(_ranked(radius_join(left, sources, width).where(other).select("i", "j", "d2"), k).select("i", "rank", "j", "d2"))
        done = near if done is None else done.unionByName(near)
        if width > reach:
            return _whole(done, k)
        full = near.where(F.col("rank") == k).select(F.col("i").alias("id"))
        left = _kept(left.join(full, "id", "left_anti"))
        if left.limit(1).count() == 0:
            return _whole(done, k)
        width *= 2


def _whole(found: DataFrame, k: int) -> DataFrame:
    """Only the complete answers; a target has one, as it is searched again only while it lacks some."""
    first = found.withColumn("n", F.max("rank").over(Window.partitionBy("i"))).where(F.col("n") == k)
    return _ranked(first.dropDuplicates(["i", "j"]), k).select("i", "rank", "j", "d2")


def nearest_distance(points: DataFrame) -> DataFrame:
    """(i, j, distance) to the nearest other point."""
    return knn(points, points, 1, exclude_self=True).select("i", "j", F.sqrt("d2").alias("distance"))


def neighbourhoods(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets of neighbours (key, members) and (i, key) for each target."""
    by = near.groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("members"))
    keyed = by.withColumn("key", F.concat_ws(",", F.transform("members", lambda v: v.cast("string"))))
    return keyed.select("key", "members").dropDuplicates(["key"]), keyed.select("i", "key")


def box_join(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """(i, j) of boxes (id, lo0.., hi0..) that overlap, borders included; a pair is given by the cell that holds its overlap's lower corner.

    width: of the cells, about a box's usual extent.
    """
    dims = range(sum(c.startswith("lo") for c in a.columns))
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")

    def spread(df: DataFrame, ident: str, mark: str) -> DataFrame:
        out = df.select(F.col("id").alias(ident), *(F.col(f"{e}{k}").alias(f"{mark}{e}{k}") for e in ("lo", "hi") for k in dims))
        for k in dims:
            out = out.withColumn(f"c{k}", F.explode(F.sequence(cell(F.col(f"{mark}lo{k}")), cell(F.col(f"{mark}hi{k}")))))
        return out

    both = spread(a, "i", "a").join(spread(b, "j", "b"), [f"c{k}" for k in dims])
    for k in dims:
        both = both.where((F.col(f"alo{k}") <= F.col(f"bhi{k}")) & (F.col(f"blo{k}") <= F.col(f"ahi{k}")))
        both = both.where(cell(F.greatest(f"alo{k}", f"blo{k}")) == F.col(f"c{k}"))
    return both.select("i", "j")

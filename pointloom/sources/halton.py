"""Halton points without state: any range of the sequence is a range of ids with a digit sum for each prime base."""

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out if p * p <= k):
            out.append(k)
        k += 1
    return out


def radical_inverse(i: Column, base: int, most: int) -> Column:
    """Digits of i (at most most) mirrored at the point."""
    value, scale, k = None, 1, 0
    while scale <= most:
        t = F.pmod(F.floor(i / F.lit(scale)), F.lit(base)).cast("double") / float(scale * base)
        value = t if value is None else value + t
        scale, k = scale * base, k + 1
    return F.lit(0.0) if value is None else value


def halton(spark: SparkSession, size: int, dim: int = 1, start: int = 0, skip: int = 1, prime_index: int = 0) -> DataFrame:
    """id and x0..: element n belongs to the integer start + 1 + skip * n."""
    most = start + 1 + skip * max(size - 1, 0)
    i = F.lit(start + 1) + F.lit(skip) * F.col("id")
    bases = primes(prime_index + dim)[prime_index:]
    return spark.range(size).select("id", *(radical_inverse(i, b, most).alias(f"x{k}") for k, b in enumerate(bases)))


def randint(points: DataFrame, a: int, b: int | None = None) -> DataFrame:
    """Coordinates as integers from a to b - 1 (0 to a - 1 with one bound)."""
    low, high = (0, a) if b is None else (a, b)
    return points.select("id", *((F.col(c) * (high - low) + low).cast("bigint").alias(c) for c in points.columns[1:]))


def uniform(points: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Coordinates moved to a box."""
    return points.select("id", *((F.col(c) * (h - l) + l).alias(c) for c, l, h in zip(points.columns[1:], low, high, strict=True)))


class HaltonSequence:
    """Hands out consecutive parts of a sequence."""

    def __init__(self, spark: SparkSession, dim: int = 1, start: int = 0, skip: int = 1, prime_index: int = 0):
        self.spark, self.dim, self.count, self.skip, self.prime_index = spark, dim, start, skip, prime_index
        self._lock = threading.Lock()

    def random(self, size: int) -> DataFrame:
        with self._lock:
            start, self.count = self.count, self.count + size * self.skip
        return halton(self.spark, size, self.dim, start, self.skip, self.prime_index)

    __call__ = random

    def randint(self, a: int, b: int | None = None, size: int = 1) -> DataFrame:
        return randint(self.random(size), a, b)

    def uniform(self, low, high, size: int) -> DataFrame:
        return uniform(self.random(size), low, high)


class GlobalHaltonSequence(HaltonSequence):
    """All instances share one counter, which begins at 100."""

    _shared = 100
    _shared_lock = threading.Lock()

    def random(self, size: int) -> DataFrame:
        with GlobalHaltonSequence._shared_lock:
            start = GlobalHaltonSequence._shared
            GlobalHaltonSequence._shared += size * self.skip
        return halton(self.spark, size, self.dim, start, self.skip, self.prime_index)

    __call__ = random

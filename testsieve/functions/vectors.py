"""Column expressions over arrays of numbers. All sums run from left to right in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once: a lambda over an array otherwise computes it again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / F.when(both == 0, 1.0).otherwise(both))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def combined(sem_a: Column, sem_b: Column, cov_a: Column, cov_b: Column, sem: float = 0.7, cov: float = 0.3) -> Column:
    s, c = cosine(sem_a, sem_b), cosine(cov_a, cov_b)
    return F.struct((sem * s + cov * c).alias("combined"), s.alias("semantic"), c.alias("coverage"))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def min_max(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Scaled to a range; the spread of a constant vector counts as 1."""
    def scaled(e: Column) -> Column:
        spread = F.when(e["b"] - e["a"] == 0, 1.0).otherwise(e["b"] - e["a"])
        return F.transform(v, lambda x: low + (high - low) * (x - e["a"]) / spread)

    return let(F.struct(F.array_min(v).alias("a"), F.array_max(v).alias("b")), scaled)


def standardize(v: Column, eps: float = 1e-12) -> Column:
    """Less the mean, by the population's standard deviation."""

    def scaled(mean: Column) -> Column:
        std = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(v))
        return let(F.greatest(std, F.lit(eps)), lambda d: F.transform(v, lambda x: (x - mean) / d))

    return let(total(v) / F.size(v), scaled)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union == 0, 1).otherwise(union))


def entropy_bits(ones: Column, length: int) -> Column:
    """Binary entropy of a bit vector with so many ones; 0 where all are alike."""
    p = ones / length
    h = -(p * F.log2(p)) - (1 - p) * F.log2(1 - p)
    return F.when((ones == 0) | (ones == length), 0.0).otherwise(h)


def entropy_values(v: Column) -> Column:
    """Entropy of absolute values as shares, by the most that so many values can have."""

    def entropy(mass: Column) -> Column:
        h = F.aggregate(v, F.lit(0.0), lambda a, x: a - F.when(x == 0, 0.0).otherwise(F.abs(x) / mass * F.log2(F.abs(x) / mass)))
        return F.when((F.size(v) <= 1) | (mass == 0), 0.0).otherwise(h / F.log2(F.size(v).cast("double")))

    return let(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)), entropy)

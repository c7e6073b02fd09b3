"""Vector quality by entropy, and weights that damp vectors of little information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import entropy_bits, entropy_values, l2_normalize

SEMANTIC_LEAST, COVERAGE_LEAST, LOW_QUALITY = 0.5, 0.85, 0.5


def _bit_entropy(v: Column) -> Column:
    ones, n = F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v)
    p = ones / n
    return F.when((ones == 0) | (ones == n), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def quality(rows: DataFrame, sem_least: float = SEMANTIC_LEAST, cov_least: float = COVERAGE_LEAST) -> DataFrame:
    """rows(id, sem, cov): sem of numbers, cov of bits -> entropies, qualities (entropy by its least good value, at most 1),
    overall (0.7 and 0.3), whether that is low, and what is wrong."""
    r = rows.select("id", entropy_values(F.col("sem")).alias("semantic_entropy"), _bit_entropy(F.col("cov")).alias("coverage_entropy"))
    r = r.withColumn("semantic_quality", F.least(F.lit(1.0), F.col("semantic_entropy") / sem_least)).withColumn("coverage_quality", F.least(F.lit(1.0), F.col("coverage_entropy") / cov_least))
    r = r.withColumn("overall", 0.7 * F.col("semantic_quality") + 0.3 * F.col("coverage_quality"))
    issues = F.filter(
        F.array(F.when(F.col("semantic_entropy") < sem_least, F.lit("low semantic entropy")), F.when(F.col("coverage_entropy") < cov_least, F.lit("low coverage entropy"))), lambda x: x.isNotNull()
    )
    return r.withColumn("low_quality", F.col("overall") < LOW_QUALITY).withColumn("issues", issues)


def combine(sem: DataFrame, cov: DataFrame, sem_dim: int = 128, cov_dim: int = 512) -> DataFrame:
    """sem(id, v), cov(id, v) -> (id, v): both parts of every id, zeros for a missing one, unit length; an error for a part of
    another dimension."""
    def part(c: str, dim: int) -> Column:
        return F.when(F.col(c).isNull(), F.array_repeat(F.lit(0.0), dim)).when(F.size(c) != dim, F.raise_error(F.lit(f"vectors must have {dim} columns")).cast("array<double>")).otherwise(F.col(c))

    met = sem.select("id", F.col("v").alias("s")).join(cov.select("id", F.col("v").alias("c")), "id", "full")
    return met.select("id", l2_normalize(F.concat(part("s", sem_dim), part("c", cov_dim))).alias("v"))


def damp(rows: DataFrame, weights: DataFrame, split: int) -> DataFrame:
    """rows(id, v), weights(id, ws, wc): the first `split` numbers times ws, the rest times wc, unit length."""
    met = rows.join(weights, "id")
    return met.select("id", l2_normalize(F.transform("v", lambda x, i: F.when(i < split, x * F.col("ws")).otherwise(x * F.col("wc")))).alias("v"))


def weights(quality_rows: DataFrame) -> DataFrame:
    """(id, ws, wc): the weights that damp() takes, the qualities of both parts."""
    return quality_rows.select("id", F.col("semantic_quality").alias("ws"), F.col("coverage_quality").alias("wc"))


def summary(quality_rows: DataFrame) -> DataFrame:
    """One row: least, most, mean and population deviation of the three measures, and the rows of low quality."""
    out = []
    for c in ("semantic_entropy", "coverage_entropy", "overall"):
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return quality_rows.agg(*out, F.sum(F.col("low_quality").cast("long")).alias("low_quality"))


__all__ = ["combine", "damp", "entropy_bits", "quality", "summary", "weights"]

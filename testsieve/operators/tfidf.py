"""TF-IDF in long form (id, idx, value), projections of it, and dense vectors from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize

MIN_DF, MAX_DF, MAX_FEATURES = 0.01, 0.95, 5000
SEMANTIC_DIM, CODE_FEATURES, CODE_DIM = 128, 768, 384


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(id, tokens) -> (id, term, n)."""
    return docs.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, docs: DataFrame, min_df: float = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, df, idf, idx): the terms in between the frequency bounds, at most max_features by frequency (ties by term), numbered
    in order. Bounded by max_features, so the numbering may run in one task and the table may be broadcast."""
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))
    kept = df.where((F.col("df") >= F.floor(F.lit(min_df) * F.col("docs"))) & (F.col("df") <= F.floor(F.lit(max_df) * F.col("docs"))))
    kept = kept.orderBy(F.desc("df"), "term").limit(max_features)
    return kept.select("term", "df", (F.log(F.col("docs") / F.col("df")) + 1).alias("idf"), (F.row_number().over(Window.orderBy("term")) - 1).cast("long").alias("idx"))


def transform(counts: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """(id, idx, value); rows aren't normalized."""
    tf = 1 + F.log("n") if sublinear else F.col("n").cast("double")
    return counts.join(F.broadcast(vocab), "term").select("id", "idx", (tf * F.col("idf")).alias("value"))


def projection(size: int, dim: int = SEMANTIC_DIM, seed: int = 42) -> np.ndarray:
    """A Gaussian projection with unit columns; where the vocabulary is no larger than dim, the identity, padded."""
    if size <= dim:
        return np.eye(size, dim)
    m = np.random.RandomState(seed).randn(size, dim)
    return m / np.linalg.norm(m, axis=0)


def project(spark, rows: DataFrame, ids: DataFrame, size: int, dim: int = SEMANTIC_DIM, seed: int = 42) -> DataFrame:
    """rows(id, idx, value) times the projection, unit length; ids without terms get zeros. (id, vec)

    The matrix is size x dim numbers (at most MAX_FEATURES x dim) and is broadcast in long form by column blocks of a row."""
    matrix = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(projection(size, dim, seed))], "idx long, p array<double>")
    parts = rows.join(F.broadcast(matrix), "idx").select("id", F.posexplode(F.transform("p", lambda x: x * F.col("value"))).alias("k", "x"))
    sums = parts.groupBy("id", "k").agg(F.sum("x").alias("x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("kx"))
    vec = F.coalesce(F.transform("kx", lambda s: s["x"]), F.array_repeat(F.lit(0.0), dim))
    return ids.join(sums, "id", "left").select("id", l2_normalize(vec).alias("vec"))


def code_vocabulary(counts: DataFrame, docs: DataFrame, max_features: int = CODE_FEATURES) -> DataFrame:
    """(term, idf, idx): the most frequent terms by total count (ties by term), numbered in order; idf is ln(N / df)."""
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    terms = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    terms = terms.crossJoin(F.broadcast(total))
    return terms.select("term", F.log(F.col("docs") / F.col("df")).alias("idf"), (F.row_number().over(Window.orderBy("term")) - 1).cast("long").alias("idx"))


def code_vectors(counts: DataFrame, docs: DataFrame, dim: int = CODE_DIM) -> DataFrame:
    """(id, idx, value): term share times idf, unit length over the whole vocabulary, then only the first dim terms."""
    vocab = code_vocabulary(counts, docs)
    size = docs.select("id", F.size("tokens").alias("len"))
    rows = counts.join(F.broadcast(vocab), "term").join(size, "id").select("id", "idx", (F.col("n") / F.col("len") * F.col("idf")).alias("x"))
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    out = rows.join(norm, "id").where(F.col("idx") < dim)
    return out.select("id", "idx", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("value"))


def dense(rows: DataFrame, dim: int = CODE_DIM) -> DataFrame:
    """(id, vec) of long-form rows, zeros where nothing is."""
    maps = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    return maps.select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))

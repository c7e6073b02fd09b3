"""The reduction run: sources and coverage -> vectors -> clusters -> safety -> redundancy -> findings. One plan per step; the
clustering loops are the only points where the driver decides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import doubles
from ..operators import cluster, entropy, findings, metrics, reduce, safety, sketch, store, tfidf
from ..operators.settle import settle
from .config import Settings


@dataclass
class Result:
    clusters: DataFrame  # (cluster_id, id, name)
    redundancy: DataFrame
    findings: DataFrame
    summary: DataFrame
    dropped: DataFrame  # tests that the safety split left alone


def vectorize(spark: SparkSession, sources: DataFrame, settings: Settings) -> DataFrame:
    """sources(id, source) -> (id, v) of the semantic dimension."""
    docs = sources.select("id", T.tokenize(F.coalesce("source", F.lit(""))).alias("tokens"))
    counts = tfidf.term_counts(docs).persist()
    vocab = tfidf.vocabulary(counts, docs, max_features=settings.max_features).persist()
    rows = tfidf.transform(counts, vocab)
    out = tfidf.project(spark, rows, docs.select("id"), vocab.count(), settings.semantic_dim)
    return out.select("id", F.col("vec").alias("v"))


def fingerprint(lines: DataFrame) -> DataFrame:
    """lines(test_case_id, file, line) -> (id, v): bits as numbers."""
    prints = sketch.bloom(lines)
    bits = F.transform(F.sequence(F.lit(0), F.lit(sketch.BITS - 1)), lambda i: F.array_contains("bits", i).cast("double"))
    return prints.select(F.col("test_case_id").alias("id"), bits.alias("v"))


def cluster_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    """(id, cluster_id) by the algorithm of the settings, after its preparation."""
    name = cluster.ALIASES.get(settings.algorithm, settings.algorithm)
    n = rows.count()
    if name == "hierarchical":
        return cluster.agglomerative(reduce.standardize(rows), settings.linkage, settings.n_clusters, settings.distance_threshold)
    if name == "dbscan":
        if len(rows.first()["v"]) > 128:
            pca = reduce.PCA(min(128, max(1, n - 1)), standardized=False).fit(rows)
            rows = pca.transform(rows).select("id", F.slice("v", 1, reduce.components_for(pca.explained())).alias("v"))
            rows = settle(rows, "reduced")
        samples = cluster.min_samples_for(n, settings.min_samples)
        eps = settings.eps if settings.eps is not None else cluster.best_eps(rows, samples)[0]
        return cluster.dbscan(rows, eps, samples)
    if name == "kmeans":
        kept = reduce.varying_columns(rows)
        rows = rows.select("id", F.transform(F.array(*[F.lit(k + 1) for k in kept]), lambda k: F.element_at("v", k)).alias("v"))
        rows = reduce.standardize(rows) if len(kept) <= 128 else reduce.PCA(min(128, max(1, n - 1)), whiten=True).fit(rows).transform(rows)
        return cluster.merge_small(cluster.kmeans(settle(rows, "prepared"), settings.n_clusters, 2, settings.max_clusters))
    return cluster.get_clusterer(name)(rows)


def vectors(spark: SparkSession, sources: DataFrame, lines: DataFrame, settings: Settings) -> DataFrame:
    """(id, v): the semantic and the coverage part of every source."""
    sem, cov = vectorize(spark, sources, settings), fingerprint(lines)
    return entropy.combine(sem, cov, settings.semantic_dim, sketch.BITS).join(sources.select("id"), "id", "left_semi")


def run(spark: SparkSession, sources: DataFrame, lines: DataFrame, tests: DataFrame, settings: Settings = Settings()) -> Result:  # noqa: B008
    """sources(id, source), lines(test_case_id, file, line), tests(id, path, method, exec_time_ms)."""
    rows = settle(vectors(spark, sources, lines, settings), "vectors")
    if settings.entropy_damping:
        parts = rows.select("id", F.slice("v", 1, settings.semantic_dim).alias("sem"), F.slice("v", settings.semantic_dim + 1, sketch.BITS).alias("cov"))
        rows = settle(entropy.damp(rows, entropy.weights(entropy.quality(parts)), settings.semantic_dim), "damped")
    names = tests.select("id", F.concat_ws("::", "path", "method").alias("name"))
    found = settle(cluster_rows(rows, settings).select("id", F.col("cluster_id").cast("long").alias("cluster_id")).join(names, "id"), "clusters")
    safe = found
    if settings.validate_safety:
        split = settle(safety.split_unsafe(found.select("cluster_id", "name").distinct()), "split")
        split = safety.semantic_split(split).select("cluster_id", "name").distinct()
        safe = settle(split.join(names, "name").select("id", "cluster_id", "name"), "safe")
    dropped = found.join(safe.select("id"), "id", "left_anti")
    counts = store.line_counts(lines).withColumnRenamed("test_case_id", "id")
    members = safe.join(rows, "id").join(tests.select("id", "exec_time_ms"), "id").join(counts, "id", "left")
    members = settle(members.select("cluster_id", "id", doubles(F.col("v")).alias("v"), "exec_time_ms", "lines_covered"), "members")
    split_at, sem_w, cov_w = settings.semantic_dim, settings.semantic_weight, settings.coverage_weight
    pairs = findings.cluster_pairs(members, _combined(split_at, sem_w, cov_w))
    pairs = settle(pairs, "pairs")
    redundant = findings.redundant_tests(members, pairs, settings.levels, settings.include_noise)
    return Result(safe, redundant, findings.ordered(findings.findings(members, pairs, lines, settings.high_threshold, settings.threshold)), findings.redundancy_summary(redundant), dropped)


def _combined(split: int, sem: float, cov: float) -> Callable:
    from functools import partial

    from ..operators.pairs import combined_kernel

    return partial(combined_kernel, split=split, sem=sem, cov=cov)


PIPELINES: dict[str, Callable] = {"kmeans": run, "dbscan": run, "hierarchical": run}


def register(name: str, f: Callable) -> None:
    PIPELINES[name] = f


def create(name: str) -> Callable:
    name = cluster.ALIASES.get(name, name)
    if name not in PIPELINES:
        raise ValueError(f"unknown pipeline {name}; there are {', '.join(sorted(PIPELINES))}")
    return PIPELINES[name]


def _probe(batches):
    """What a worker can import, a row each."""
    import importlib

    import pyarrow as pa

    for batch in batches:
        names = batch.column("part").to_pylist()
        told = []
        for name in names:
            try:
                told.append(str(importlib.import_module(name).__version__))
            except ImportError:
                told.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(told, pa.string())], ["part", "told"])


def environment(spark: SparkSession) -> DataFrame:
    """(part, ok, told): whether workers start, have the libraries that the operators need, and share a folder that can be written."""
    parts = spark.createDataFrame([(n,) for n in ("numpy", "pandas", "pyarrow", "pyspark")], "part string")
    try:
        found = parts.mapInArrow(_probe, "part string, told string").collect()  # four rows
        rows = [("workers", True, "start"), *((r["part"], r["told"] is not None, r["told"] or "missing") for r in found)]
    except Exception as e:  # noqa: BLE001 - whatever keeps workers from starting is the finding
        rows = [("workers", False, str(e).splitlines()[0])]
    try:
        settle(spark.range(1), "probe").count()
        rows.append(("checkpoint folder", True, "can be written"))
    except Exception as e:  # noqa: BLE001
        rows.append(("checkpoint folder", False, str(e).splitlines()[0]))
    return spark.createDataFrame(rows, "part string, ok boolean, told string")


def describe(result: Result) -> DataFrame:
    """One row: tests, clusters, findings and redundant tests of a run."""
    sizes = metrics.size_stats(result.clusters)
    return sizes.crossJoin(findings.report_counts(result.findings))

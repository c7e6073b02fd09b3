"""Writers: facts by run, JSON maps, CSV and text reports, the feedback log. Rows are written where they are; only reports,
which people read, come to the driver, row by row."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import ordered
from .readers import FEEDBACK, feedback_log


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def replace(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Writes df beside the path, then takes its place: df may read from the path, and a failed write leaves it as it was."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(beside)
    fs, target = _filesystem(spark, path)
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(_filesystem(spark, beside)[1], target):
        raise OSError(f"can't rename {beside}")


def append_facts(df: DataFrame, path: str) -> None:
    """Appends facts, one folder per run; rows of a run meet in few files."""
    df.repartition("test_run_id").write.mode("append").partitionBy("test_run_id").parquet(path)


def create_run(spark: SparkSession, path: str, run_id: int, commit: str) -> None:
    row = spark.range(1).select(F.lit(run_id).cast("long").alias("id"), F.lit(commit).alias("git_commit_hash"), F.current_timestamp().alias("executed_at"), F.current_timestamp().alias("created_at"))
    row.write.mode("append").parquet(path)


def delete_older_than(spark: SparkSession, path: str, date: str) -> int:
    """Removes the runs created before a date; returns how many."""
    runs = spark.read.parquet(path)
    old = F.col("created_at") < F.lit(date).cast(dict(runs.dtypes)["created_at"])
    n = runs.where(old).count()
    if n:
        replace(runs.where(~F.coalesce(old, F.lit(False))), path)
    return n


def write_json_map(df: DataFrame, path: str) -> None:
    """df(name, value) as JSON lines {name: value}."""
    df.select(F.to_json(F.map_from_arrays(F.array("name"), F.array("value"))).alias("value")).write.mode("overwrite").text(path)


def write_json_objects(df: DataFrame, path: str, names: int = 5000) -> None:
    """df(name, value) as files of one JSON object each, of about so many names."""
    files = max(1, -(-df.count() // names))
    maps = df.groupBy(F.pmod(F.xxhash64("name"), F.lit(files)).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "value")))).alias("value"))
    maps.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_clusters(clusters: DataFrame, metadata: dict, path: str) -> None:
    """clusters(cluster_id, name): one JSON line per cluster and one of metadata."""
    rows = clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list("name")).alias("tests"))
    lines = rows.select(F.to_json(F.struct("cluster_id", "tests")).alias("value"))
    lines.union(clusters.sparkSession.createDataFrame([(json.dumps({"metadata": metadata}, sort_keys=True),)], "value string")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=delimiter)


def metrics_rows(metrics: DataFrame) -> DataFrame:
    """One row of measures -> (Metric, Value), four decimals for those that aren't whole."""
    def text(name: str, kind: str):
        return F.format_string("%.4f", F.col(name)) if kind in ("double", "float") else F.col(name).cast("string")

    pairs = F.array(*[F.struct(F.lit(n).alias("Metric"), text(n, k).alias("Value")) for n, k in metrics.dtypes])
    return metrics.select(F.explode(pairs).alias("p")).select("p.*")


PRIORITIES = ("high", "medium", "low")


def _parts(found: DataFrame) -> Iterator[Row]:
    yield from ordered(found).toLocalIterator()


def markdown(found: DataFrame, counts: Row) -> Iterator[str]:
    """The lines of a report: counts, then findings by priority."""
    yield from ("# Test redundancy report", "", f"- Findings: {counts['findings']}", f"- High: {counts['high']}", f"- Medium: {counts['medium']}", f"- Low: {counts['low']}", f"- Redundant tests: {counts['redundant_tests']}")
    now = None
    for f in _parts(found):
        if f["priority"] != now:
            now = f["priority"]
            yield from ("", f"## {now.title()} priority")
        yield from ("", f"### Cluster {f['cluster_id']}", f"- Representative: {f['representative']}", f"- Similarity: {round(f['score'] * 100)}%", f"- Redundant: {', '.join(map(str, f['redundant_tests']))}", f"- {f['recommendation']}")


def html_report(found: DataFrame, counts: Row) -> Iterator[str]:
    """As markdown(), in HTML; all texts are escaped."""
    yield "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Test redundancy report</title></head><body><h1>Test redundancy report</h1><ul>"
    for name in ("findings", *PRIORITIES, "redundant_tests"):
        yield f"<li>{name.replace('_', ' ').title()}: {counts[name]}</li>"
    yield "</ul>"
    for f in _parts(found):
        yield f"<section class='{html.escape(f['priority'])}'><h2>Cluster {f['cluster_id']}</h2><p>Representative: {html.escape(str(f['representative']))}</p><p>{html.escape(f['recommendation'])}</p></section>"
    yield "</body></html>"


def _json_lines(found: DataFrame, counts: Row) -> Iterator[str]:
    yield "["
    before = None
    for f in _parts(found):
        if before is not None:
            yield before + ","
        before = "  " + json.dumps(f.asDict(recursive=True), sort_keys=True)
    if before is not None:
        yield before
    yield "]"


def _yaml_lines(found: DataFrame, counts: Row) -> Iterator[str]:
    """Findings as a YAML list; scalars in JSON form, which YAML reads."""
    for f in _parts(found):
        for i, (k, v) in enumerate(f.asDict(recursive=True).items()):
            yield f"{'-' if i == 0 else ' '}   {k}: {json.dumps(v)}"


FORMATS = {"json": _json_lines, "yaml": _yaml_lines, "markdown": markdown, "md": markdown, "html": html_report}


def save_findings(found: DataFrame, counts: DataFrame, fmt: str, path: str) -> None:
    """Writes a report as one file, a finding at a time, wherever the path lies."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; there are {', '.join(sorted(FORMATS))}")
    fs, target = _filesystem(found.sparkSession, path)
    out = fs.create(target, True)
    try:
        for line in FORMATS[fmt](found, counts.first()):
            out.write(bytearray(f"{line}\n", "utf-8"))
    finally:
        out.close()


def append_feedback(spark: SparkSession, path: str, cluster_id: int, action: str, reason: str, timestamp: str) -> None:
    if action not in ("keep", "ignore", "merge"):
        raise ValueError(f"unknown action {action}")
    spark.createDataFrame([(cluster_id, action, reason, timestamp)], FEEDBACK).write.mode("append").json(path)


def update_run(spark: SparkSession, path: str, run_id: int, **values: str) -> None:
    """Sets columns of one run. Files aren't changed in place: the (small) table of runs is written anew."""
    runs = spark.read.parquet(path)
    mine = F.col("id") == run_id
    replace(runs.select(*[F.when(mine, F.lit(values[c]).cast(k)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, k in runs.dtypes]), path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The log's latest line of each cluster, by timestamp."""
    rows = feedback_log(spark, path)
    return rows.groupBy("cluster_id").agg(F.max_by(F.struct("action", "reason", "timestamp"), F.col("pos")).alias("f")).select("cluster_id", "f.*")


def _rewrite_json(df: DataFrame, path: str) -> None:
    """Writes beside the path, then takes its place."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.json(beside)
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)
    fs.rename(_filesystem(spark, beside)[1], target)


def compact_feedback(spark: SparkSession, path: str) -> None:
    """Leaves one line per cluster."""
    _rewrite_json(read_feedback(spark, path), path)


def clear_feedback(spark: SparkSession, path: str, cluster_id: int | None = None) -> None:
    """Removes the feedback of a cluster, or all of it."""
    if cluster_id is None:
        fs, target = _filesystem(spark, path)
        fs.delete(target, True)
    else:
        _rewrite_json(read_feedback(spark, path).where(F.col("cluster_id") != cluster_id), path)


def export_feedback(spark: SparkSession, path: str, to: str) -> None:
    read_feedback(spark, path).write.mode("overwrite").json(to)


def import_feedback(spark: SparkSession, path: str, exported: str) -> None:
    """Appends exported feedback; an error where it isn't feedback."""
    rows = spark.read.schema(FEEDBACK).json(exported)
    if not rows.where("cluster_id is null or action is null").isEmpty():
        raise ValueError("invalid feedback")
    rows.write.mode("append").json(path)


def save_results(result, counts: DataFrame, settings: dict, folder: str, save_vectors: DataFrame | None = None, save_csv: bool = True) -> None:
    """clusters, redundancy report (CSV), results (JSON lines) and, if given, vectors(name, value) under a folder."""
    from ..operators.findings import csv_rows

    write_clusters(result.clusters, settings, f"{folder}/clusters.json")
    if save_csv:
        write_csv(csv_rows(result.redundancy), f"{folder}/redundancy_report.csv")
    if save_vectors is not None:
        write_json_map(save_vectors, f"{folder}/vectors.json")
    counts.write.mode("overwrite").json(f"{folder}/results.json")

"""python -m testsieve ingest|vectorize|cluster|analyze|validate|reduce ...: the engine from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import entropy, findings, safety
from .plans import pipeline
from .plans.config import PRESETS
from .sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="testsieve")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="store the facts of a coverage report")
    ingest.add_argument("report")
    ingest.add_argument("store")
    ingest.add_argument("--run", type=int, required=True)
    ingest.add_argument("--commit", default="unknown")
    for name, text in (("reduce", "findings of a suite"), ("cluster", "clusters of a suite"), ("vectorize", "vectors of a suite")):
        c = sub.add_parser(name, help=text)
        c.add_argument("sources", help="JSON map of test names to source texts")
        c.add_argument("coverage", help="JSON map of test names to file:line lists")
        c.add_argument("output")
        c.add_argument("--preset", choices=sorted(PRESETS), default="default")
        c.add_argument("--config", help="JSON file of settings")
        c.add_argument("--algorithm")
        c.add_argument("--threshold", type=float)
        c.add_argument("--format", dest="output_format")
    for name in ("analyze", "validate"):
        sub.add_parser(name).add_argument("input")
    return p


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("testsieve").getOrCreate()
    if a.command == "ingest":
        head = spark.read.text(a.report).limit(2).agg(F.coalesce(F.array_join(F.collect_list("value"), "\n"), F.lit("")).alias("head"))
        clover = head.select(readers.format_of(F.lit(a.report), F.col("head"))).first()[0] == "clover"
        facts = readers.clover_lines(spark, a.report).withColumn("test", F.lit("Tests\\Unit\\DefaultTest::testGeneral")) if clover else readers.coverage_text(spark, a.report)
        sinks.append_facts(readers.identified(facts).select(F.lit(a.run).alias("test_run_id"), "path", "method", "file", "line"), f"{a.store}/coverage")
        sinks.create_run(spark, f"{a.store}/runs", a.run, a.commit)
    elif a.command == "analyze":
        v = readers.vectors_json(spark, a.input).select(F.col("name").alias("id"), F.slice("v", 1, 128).alias("sem"), F.slice("v", 129, 512).alias("cov"))
        entropy.summary(entropy.quality(v)).show(vertical=True, truncate=False)
    elif a.command == "validate":
        found = safety.cluster_safety(readers.clusters_json(spark, a.input))
        safety.validation_summary(found).show(truncate=False)
        safety.reasons(found).show(truncate=False)
    else:
        settings = PRESETS[a.preset]
        if a.config:
            settings = settings.with_overrides(json.loads("".join(r["value"] for r in spark.read.text(a.config, wholetext=True).collect())))  # a small file
        settings = settings.with_overrides({k: v for k, v in (("algorithm", a.algorithm), ("threshold", a.threshold), ("output_format", a.output_format)) if v is not None})
        sources = readers.test_sources(spark, a.sources).withColumn("id", F.xxhash64("name"))
        lines = readers.coverage_json(spark, a.coverage).select(F.xxhash64("name").alias("test_case_id"), "file", "line").distinct()
        tests = readers.identified(sources.select("id", "name"), "name").withColumn("exec_time_ms", F.lit(None).cast("double"))
        if a.command == "vectorize":
            rows = pipeline.vectors(spark, sources.select("id", "source"), lines, settings).join(sources.select("id", "name"), "id")
            sinks.write_json_map(rows.select("name", F.col("v").alias("value")), a.output)
            return 0
        result = pipeline.create(settings.algorithm)(spark, sources.select("id", "source"), lines, tests, settings)
        if a.command == "cluster":
            sinks.write_clusters(result.clusters, settings.as_dict(), a.output)
        else:
            sinks.save_findings(result.findings, findings.report_counts(result.findings), settings.output_format, a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

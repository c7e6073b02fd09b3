"""Incremental ingest with Structured Streaming: coverage facts that arrive as files are deduplicated and appended per run, and
feedback is kept as the latest action per cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FACT_SCHEMA = "test_run_id bigint, test_case_id bigint, file string, line int, seen_at timestamp"


def coverage_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Facts of a folder of JSON files, each once within the watermark; state older than that is dropped."""
    facts = spark.readStream.schema(FACT_SCHEMA).json(path)
    return facts.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["test_run_id", "test_case_id", "file", "line"])


def write_facts(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there and stops; the checkpoint makes every file count once."""
    writer = facts.writeStream.format("parquet").partitionBy("test_run_id").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def lines_per_window(facts: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Coverage rows per run and event-time window."""
    return facts.groupBy(F.window("seen_at", width), "test_run_id").agg(F.count(F.lit(1)).alias("lines"))


def latest_feedback(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The latest action per cluster of what is known and a micro-batch; (cluster_id, action, reason, timestamp)."""
    both = known.unionByName(batch.select(*known.columns))
    return both.groupBy("cluster_id").agg(F.max_by(F.struct("action", "reason", "timestamp"), F.col("timestamp")).alias("f")).select("cluster_id", "f.*")

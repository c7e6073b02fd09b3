"""Cutting lineage: a frame written to the shared checkpoint folder and read back, so that what follows plans from a scan and a
lost executor costs a reread."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that driver and executors share, deleted when the driver ends. Only a run in one JVM, where
    all share any folder, may leave spark.checkpoint.dir unset."""
    folder, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not folder and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(folder or os.path.join(tempfile.gettempdir(), 'checkpoints')).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

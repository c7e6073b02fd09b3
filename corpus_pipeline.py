"""Corpus preparation from raw documents to token counts, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from testsieve.llm.bpe import bpe_stage
from testsieve.llm.common import cut, drop_since, held
from testsieve.llm.decontam import decontam_stage
from testsieve.llm.langid import langid_stage
from testsieve.llm.line_dedup import line_dedup_stage
from testsieve.llm.simhash import dedup_stage

STAGES = [
    ("language ID", langid_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontam_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: A trained classifier, edit distances, components and merges: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(held())
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
        # what the stage and the ones before it wrote has had its last reader
        drop_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline over documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hodoscope.llm.common import cut
from hodoscope.llm.decontam import decontaminate_stage
from hodoscope.llm.linedup import line_dedup_stage
from hodoscope.llm.neardup import neardup_stage
from hodoscope.llm.packing import pack_stage
from hodoscope.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontaminate_stage),
    ("packing", pack_stage),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against the stages done one by one without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

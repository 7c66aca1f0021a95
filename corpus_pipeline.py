"""The corpus pipeline: toxicity, near duplicates, personal data, mix, packing, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedgeline.llm.common import documents, stage
from sedgeline.llm.jaccard import near_duplicates_stage
from sedgeline.llm.mixing import mix_stage
from sedgeline.llm.packing import pack_stage
from sedgeline.llm.pii import redact_stage
from sedgeline.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", redact_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: A fitted model, hashes and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

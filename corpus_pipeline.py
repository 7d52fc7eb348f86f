"""The corpus pipeline: each stage works on all that the one before it kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satledger.llm import pipeline_stages as stages
from satledger.llm.common import read_table, recorded, remove, store

STAGES = [
    ("toxicity", stages.toxicity),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("sharding", stages.sharding),
]

#: SQL can't express the learned and the sampling stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what
    its stage kept on the way goes."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept: list[str] = []
        with recorded(kept):
            result = stage(spark, docs, sf_dir)
        docs = store(result, f"pipeline-{name}")
        remove(spark, kept)
    return docs

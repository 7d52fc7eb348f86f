"""The stages of ``corpus_pipeline.py``: ``(spark, docs, sf_dir) -> DataFrame``.

All but the last return the columns of ``documents``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satledger.llm import decontam, mixing as mix, ngram_join, sharding as shard, toxicity as tox
from satledger.llm.common import as_before, read_table

#: Score from which on a document is toxic and goes.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go (``toxicity.scored`` says what nulls,
    empty and long texts, repeated rows and empty tables give); columns stay as they are."""
    scores = tox.scored(docs, read_table(spark, sf_dir, "labels")).where(F.col("toxicity") < TOXIC)
    return as_before(scores.select("doc", "text"), docs.columns, "text")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 5-word shingles, similarity 0.8 or
    more.  Texts without words are no copies of each other; see ``ngram_join.representatives``."""
    return ngram_join.representatives(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go; see ``decontam.decontaminated``."""
    return decontam.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none to three rows.  Texts without words
    weigh nothing; all else as in ``mixing.mixed``."""
    copies = mix.mixed(docs, carry=True).where("copies > 0")
    taken = copies.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return as_before(taken.select("doc"), docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row in 40 shards of near-equal bytes; see ``sharding.byte_shards``."""
    return shard.byte_shards(docs).withColumnRenamed("id", "doc_id")

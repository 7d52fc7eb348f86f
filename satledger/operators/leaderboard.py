"""Leaderboards.

Per ``(sender, action)`` count and exact amount.  The amount is the exact sum
of ``msat / 1000``, carried as BIGINT msat through the shuffle and divided once
at the end into DECIMAL(38,3).  Top-k uses ``orderBy().limit()``, which plans
as ``TakeOrderedAndProject``: each map task keeps only its k best rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import utc_epoch
from satledger.functions.predicates import fixed_show_match


def msat_to_amount(c) -> F.Column:
    return (F.col(c).cast("decimal(38,0)") / F.lit(1000)).cast("decimal(38,3)")


def leaderboard_base(inv: DataFrame, pattern: str, action: str | None = K.ACTION_BOOST,
                     since: str = K.LEADERBOARD_SINCE, show_literal: str | None = None) -> DataFrame:
    """A10 (``action`` given) / A11 (``action=None``: every action present).

    Rows need ``created_at >= since`` (UTC), an amount, episode and podcast,
    and the episode full-matching ``pattern`` (case-sensitive) or the podcast
    equal to ``show_literal``.  A missing sender is grouped as ``N/A``."""
    # a timestamp literal: the comparison reaches the Parquet scan
    cond = (F.col("created_at") >= F.timestamp_seconds(F.lit(utc_epoch(since)))) \
        & F.col("value_msat_total").isNotNull() \
        & F.col("episode").isNotNull() & F.col("podcast").isNotNull() \
        & fixed_show_match(pattern, show_literal, on="episode")
    cond = cond & (F.col("action") == F.lit(action) if action is not None
                   else F.col("action").isNotNull())
    return (inv.filter(cond)
            .groupBy(F.coalesce("sender_name_normalized", F.lit(K.MISSING_SENDER)).alias("sender"),
                     F.col("action"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("value_msat_total").alias("amount_msat"))
            .select("sender", "action", "n", msat_to_amount("amount_msat").alias("amount")))


def top(board: DataFrame, by: str, k: int = 15) -> DataFrame:
    """O4 + O5: descending by ``amount`` or ``n``; sender breaks ties."""
    return board.orderBy(F.col(by).desc(), F.col("sender").asc(), F.col("action").asc()).limit(k)


def totals(board: DataFrame) -> DataFrame:
    """A12 + A13 per action: sum of each sender's amount truncated to an
    integer, number of payments, number of senders."""
    return board.groupBy("action").agg(
        F.sum(F.floor("amount")).cast("bigint").alias("total_amount"),
        F.sum("n").cast("bigint").alias("total_count"),
        F.count(F.lit(1)).alias("senders"))

"""App share (A14) and first streamer per episode."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import epoch_of
from satledger.operators.ranking import global_rank


def app_share(inv: DataFrame) -> DataFrame:
    """Share of boosts per app, percent rounded half up, largest first;
    ``rank`` is the place in this order (app breaks ties; one row per app).

    The total is the true sum of the per-app counts (H6: the reference adds
    equal counts once).  It is a scalar subquery over the grouped result."""
    counts = (inv.filter(F.col("action") == F.lit(K.ACTION_BOOST))
              .groupBy(F.coalesce("app_name", F.lit(K.UNKNOWN_APP)).alias("app"))
              .agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    pct = F.floor(F.lit(100.0) * (F.col("n").cast("double") / total.cast("double")) + F.lit(0.5))
    shares = counts.select("app", "n", pct.cast("bigint").alias("percent"))
    return global_rank(shares, F.col("n").desc(), F.col("app")).orderBy("rank")


def first_streamer_per_episode(inv: DataFrame) -> DataFrame:
    """Earliest ``stream`` of every episode (ties: source, identifier).

    ``min`` over a struct is a partial aggregate, so a hot episode is
    pre-reduced in every map task."""
    rec = F.struct(
        F.col("creation_date"), F.col("source"), F.col("identifier"),
        F.col("sender_name"), epoch_of("created_at").alias("created_epoch"),
        F.col("app_name"), F.col("value_sat_total"))
    first = (inv.filter((F.col("action") == F.lit(K.ACTION_STREAM)) & F.col("episode").isNotNull())
             .groupBy("episode").agg(F.min(rec).alias("r")))
    return first.select("episode", "r.sender_name", "r.created_epoch", "r.app_name",
                        "r.value_sat_total", "r.source", "r.identifier")

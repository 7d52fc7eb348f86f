"""All shows in one job (J10, re-aimed from one web request per show).

Each distinct (podcast, episode) pair is tagged with every show whose pattern it
full-matches (it may match several; ``.*`` matches all) and joined back to its
payments - the replication factor is bounded by the number of configured shows.
Per-show cutoffs are a tiny aggregate (one row per show, a proven bound)
broadcast back on the show key; the sender aggregate then shuffles on
``(show, sender)`` with map-side partial aggregation.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.predicates import after, not_excluded, show_match, tier_of
from satledger.sources.store import prune_days

SENDER = "sender_name_normalized"


def tag_shows(inv: DataFrame, shows: dict[str, str], since: int,
              excluded: Iterable[str] | None = None) -> DataFrame:
    """Each payment once per show whose pattern matches.  The patterns run on the distinct
    (podcast, episode) pairs; their shows are joined back."""
    rows = prune_days(inv, since=since).filter(after(since) & not_excluded(excluded) & F.col("podcast").isNotNull())
    tags = F.array(*[F.when(show_match(p), F.lit(name)) for name, p in shows.items()])
    titles = (rows.select("podcast", "episode").distinct()
              .select(F.col("podcast").alias("_podcast"), F.col("episode").alias("_episode"), F.explode(F.array_compact(tags)).alias("show_name")))
    same = (F.col("podcast") == F.col("_podcast")) & F.col("episode").eqNullSafe(F.col("_episode"))
    return rows.join(titles, same).drop("_podcast", "_episode")


def windows(inv: DataFrame, shows: dict[str, str], since: int,
            excluded: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    tagged = tag_shows(inv, shows, since, excluded)
    cutoffs = tagged.groupBy("show_name").agg(
        F.max(F.when(F.col("action") == K.ACTION_BOOST, F.col("creation_date"))).alias("cutoff"))
    win = (tagged.join(F.broadcast(cutoffs), "show_name", "inner")
           .filter(F.col("creation_date") <= F.col("cutoff")))
    return win, cutoffs


def per_show_sender(win: DataFrame) -> DataFrame:
    sats = F.col("value_sat_total")
    boost = F.col("action") == K.ACTION_BOOST
    stream = F.col("action") == K.ACTION_STREAM
    return (win.filter(F.col(SENDER).isNotNull() & sats.isNotNull())
            .groupBy("show_name", F.col(SENDER).alias("sender")).agg(
                F.sum(F.when(boost, sats)).alias("boost_sats"),
                F.count_if(boost).alias("boost_count"),
                F.min(F.when(boost, F.col("creation_date"))).alias("first_boost"),
                F.sum(F.when(stream, sats)).alias("stream_sats"),
                F.count_if(stream).alias("stream_count"),
                F.sum(sats).alias("all_sats"),
                F.count(F.lit(1)).alias("all_count")))


def all_show_senders(inv: DataFrame, shows: dict[str, str], since: int,
                     excluded: Iterable[str] | None = None) -> DataFrame:
    win, _ = windows(inv, shows, since, excluded)
    return (per_show_sender(win).filter(F.col("boost_count") > 0)
            .select("show_name", "sender", F.col("boost_sats").alias("total_sats"), "boost_count",
                    "first_boost", tier_of("boost_sats").alias("tier")))


def all_show_summaries(inv: DataFrame, shows: dict[str, str], since: int,
                       excluded: Iterable[str] | None = None) -> DataFrame:
    """One summary row per configured show (zeros and NULL cutoff when the
    show has no boost in the window)."""
    win, cutoffs = windows(inv, shows, since, excluded)
    z = F.lit(0).cast("bigint")
    agg = per_show_sender(win).groupBy("show_name").agg(
        F.sum("boost_sats").cast("bigint").alias("boost_total_sats"),
        F.sum("boost_count").cast("bigint").alias("boost_total_boosts"),
        F.count_if(F.col("boost_count") > 0).alias("boost_total_boosters"),
        F.sum("stream_sats").cast("bigint").alias("stream_total_sats"),
        F.sum("stream_count").cast("bigint").alias("stream_total_streams"),
        F.count_if(F.col("stream_count") > 0).alias("stream_total_streamers"),
        F.sum("all_sats").cast("bigint").alias("total_sats"),
        F.sum("all_count").cast("bigint").alias("total_invoices"),
        F.count(F.lit(1)).alias("total_unique_senders"))
    names = F.broadcast(inv.sparkSession.createDataFrame([(s,) for s in shows], "show_name string"))
    out = names.join(agg, "show_name", "left").join(cutoffs, "show_name", "left")
    metrics = [c for c in agg.columns if c != "show_name"]
    return out.select("show_name", *[F.coalesce(F.col(c), z).alias(c) for c in metrics],
                      F.col("cutoff").alias("last_seen_id"))

"""Queries relative to a last-seen invoice.

The last-seen lookup (J2) is a scalar subquery keyed on ``(source,
identifier)``: its one value becomes a literal-like bound of the main filter,
so there is no cross join.  An unknown identifier gives NULL and an empty
result, as in the reference."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import epoch_of
from satledger.functions.predicates import fixed_show_match, show_match
from satledger.sources.store import NO_DAY, day_of

# Fields pulled by the legacy extracts.
LEGACY_FIELDS = ["app_name", "podcast", "episode", "sender_name_normalized",
                 "value_sat_total", "message", "source", "identifier"]


def last_seen_time(inv: DataFrame, identifier: str, source: str | None = None) -> Column:
    """Event time of the last-seen invoice, as a scalar subquery.

    With ``source=None`` every store row with the identifier is a candidate;
    "later than any of them" equals "later than the earliest", hence ``min``."""
    cond = F.col("identifier") == F.lit(identifier)
    if source is not None:
        cond = cond & (F.col("source") == F.lit(source))
    return inv.filter(cond).agg(F.min("creation_date")).scalar()


def _later(inv: DataFrame, bound: Column) -> DataFrame:
    """Rows after an event time; on the store its day prunes the partitions too."""
    if "day" in inv.columns:
        inv = inv.filter((F.col("day") >= day_of(bound)) & (F.col("day") != NO_DAY))
    return inv.filter(F.col("creation_date") > bound)


def since_identifier(inv: DataFrame, identifier: str, pattern: str, source: str | None = None,
                     show_literal: str | None = None) -> DataFrame:
    """Boosts after the last-seen invoice whose podcast matches the
    fixed, case-sensitive show pattern or equals ``show_literal``."""
    bound = last_seen_time(inv, identifier, source)
    return _later(inv, bound).filter((F.col("action") == F.lit(K.ACTION_BOOST))
                      & F.col("podcast").isNotNull()
                      & fixed_show_match(pattern, show_literal, on="podcast"))


def _extract(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    cols = LEGACY_FIELDS + (extra or [])
    return df.select(*cols, epoch_of("created_at").alias("created_epoch"))


def ballers(base: DataFrame) -> DataFrame:
    """Single payments of at least 20000 sats, amount descending.

    Rows with equal amounts are all kept (H7)."""
    return (_extract(base.filter(F.col("value_sat_total") >= K.BALLER_MIN_SATS))
            .orderBy(F.col("value_sat_total").desc(), "created_epoch", "source", "identifier"))


def normal_boosts(base: DataFrame) -> DataFrame:
    """Single payments in [2000, 20000), by time."""
    return (_extract(base.filter((F.col("value_sat_total") >= K.BOOST_MIN_SATS)
                                 & (F.col("value_sat_total") < K.BALLER_MIN_SATS)))
            .orderBy("created_epoch", "source", "identifier"))


def thanks(base: DataFrame) -> DataFrame:
    """Single payments under 2000 sats, by time."""
    return (_extract(base.filter(F.col("value_sat_total") < K.BOOST_MIN_SATS))
            .orderBy("created_epoch", "source", "identifier"))


def all_boosts(base: DataFrame) -> DataFrame:
    """Every boost after the last-seen invoice, by time."""
    return (_extract(base, ["value_msat_total", "creation_date"])
            .orderBy("created_epoch", "source", "identifier"))


def boosts_by_show(inv: DataFrame, identifier: str, pattern: str,
                   source: str | None = None) -> DataFrame:
    """Boosts after the last-seen invoice for a show regex (podcast or
    episode-with-default), event time descending."""
    bound = last_seen_time(inv, identifier, source)
    return (_extract(_later(inv, bound).filter((F.col("action") == F.lit(K.ACTION_BOOST))
                                & show_match(pattern)),
                     ["value_msat_total", "creation_date"])
            .orderBy(F.col("creation_date").desc(), "source", "identifier"))


def summary(base: DataFrame) -> DataFrame:
    """Sum, count and distinct senders of the counted boosts."""
    counted = base.filter(F.col("value_sat_total").isNotNull()
                          & F.col("sender_name_normalized").isNotNull())
    per = counted.groupBy("sender_name_normalized").agg(
        F.sum("value_sat_total").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("s").cast("bigint").alias("total_sats"),
                   F.sum("n").cast("bigint").alias("boosts"),
                   F.count(F.lit(1)).alias("senders"))


def stream_window(inv: DataFrame, identifier: str, pattern: str,
                  source: str | None = None) -> DataFrame:
    bound = last_seen_time(inv, identifier, source)
    return _later(inv, bound).filter((F.col("action") == F.lit(K.ACTION_STREAM))
                      & show_match(pattern)
                      & F.col("value_sat_total").isNotNull()
                      & F.col("sender_name_normalized").isNotNull())


def stream_summary(inv: DataFrame, identifier: str, pattern: str,
                   source: str | None = None) -> DataFrame:
    """A16 totals: sum, count, distinct streamers after the last-seen invoice."""
    per = stream_window(inv, identifier, pattern, source).groupBy("sender_name_normalized").agg(
        F.sum("value_sat_total").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("s").cast("bigint").alias("total_sats"),
                   F.sum("n").cast("bigint").alias("streams"),
                   F.count(F.lit(1)).alias("streamers"))


def stream_senders(inv: DataFrame, identifier: str, pattern: str,
                   source: str | None = None) -> DataFrame:
    """A16 set of streamers, as rows (never collected into one value)."""
    return (stream_window(inv, identifier, pattern, source)
            .select(F.col("sender_name_normalized").alias("sender")).distinct())


def earliest_boost(inv: DataFrame) -> DataFrame:
    """Every invoice whose event time equals the earliest boost time."""
    first = inv.filter(F.col("action") == F.lit(K.ACTION_BOOST)).agg(F.min("creation_date")).scalar()
    return inv.filter(F.col("creation_date") == first) \
        .select("source", "identifier", "creation_date", epoch_of("created_at").alias("created_epoch"))


def store_stats(inv: DataFrame) -> DataFrame:
    """Number of invoices and newest event time."""
    return inv.agg(F.count(F.lit(1)).alias("invoices"),
                   F.max("creation_date").alias("max_creation_date"))


def lookup(inv: DataFrame, identifier: str | None = None, created_epoch: int | None = None) -> DataFrame:
    """point lookup by identifier and/or creation time."""
    cond = F.lit(True)
    if identifier is not None:
        cond = cond & (F.col("identifier") == F.lit(identifier))
    if created_epoch is not None:
        cond = cond & (F.col("created_at") == F.timestamp_seconds(F.lit(created_epoch)))
    return inv.filter(cond)


def strip_namespaces(df: DataFrame) -> DataFrame:
    """the old flat layout calls the normalised sender ``sender_name``."""
    if "sender_name" in df.columns:
        df = df.drop("sender_name")
    return df.withColumnsRenamed({"sender_name_normalized": "sender_name"})


def alphabetical(df: DataFrame) -> DataFrame:
    """columns in alphabetical order."""
    return df.select(*sorted(df.columns))

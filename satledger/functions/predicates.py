"""Row predicates (F1-F10) as Column builders; Catalyst pushes the simple
comparisons into the Parquet scan and evaluates the regexes after them."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import col_or_lit, full_match

__all__ = [
    "after",
    "not_excluded",
    "show_match",
    "fixed_show_match",
    "tier_of",
]


def after(since, c="creation_date") -> Column:
    """exclusive event-time lower bound ``since < cd``."""
    return col_or_lit(c) > since


def not_excluded(names: Iterable[str] | None, c="sender_name_normalized") -> Column:
    """sender not in the exclusion list; a missing sender passes.

    Plain ``NOT IN`` would drop NULL senders."""
    names = list(names or [])
    if not names:
        return F.lit(True)
    return ~F.coalesce(col_or_lit(c).isin(names), F.lit(False))


def show_match(pattern: str, podcast="podcast", episode="episode") -> Column:
    """podcast present and (podcast or episode-with-default) full-matches."""
    pod = col_or_lit(podcast)
    ep = F.coalesce(col_or_lit(episode), F.lit(K.UNKNOWN_EPISODE))
    return pod.isNotNull() & (full_match(pod, pattern) | full_match(ep, pattern))


def fixed_show_match(pattern: str, literal: str | None, on="podcast") -> Column:
    """``on`` full-matches a case-sensitive pattern, or podcast equals a
    literal show name.  The legacy queries test the podcast, the leaderboards
    the episode."""
    cond = full_match(col_or_lit(on), pattern)
    if literal is not None:
        cond = cond | (F.col("podcast") == F.lit(literal))
    return cond


def tier_of(total) -> Column:
    """A4: tier of a sender's total: baller >= 20000 > boost >= 2000 > thanks."""
    t = col_or_lit(total)
    return (F.when(t >= K.BALLER_MIN_SATS, F.lit(K.TIER_BALLER))
            .when(t >= K.BOOST_MIN_SATS, F.lit(K.TIER_BOOST))
            .otherwise(F.lit(K.TIER_THANKS)))

"""Scalar column builders.

All of them are JVM-side expressions, so they stay inside whole-stage codegen
and never depend on the session time zone.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from satledger import constants as K

__all__ = [
    "col_or_lit",
    "blank_to_null",
    "trim_java",
    "normalize_sender",
    "sats_from_msat",
    "content_id",
    "full_match",
    "epoch_to_ntz",
    "format_report_date",
    "int_comma",
    "split_lines",
    "quote_lines",
    "digits_number",
    "epoch_of",
    "relative_bound",
    "seconds_between",
    "per_30",
    "utc_epoch",
    "utc_epoch_literal",
]


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def blank_to_null(c) -> Column:
    """I4: an empty string is an absent attribute."""
    return F.nullif(col_or_lit(c), F.lit(""))


def trim_java(c) -> Column:
    """Trim every character ``Character.isWhitespace`` accepts (``trim`` only
    strips the space character)."""
    return F.regexp_replace(col_or_lit(c), r"\A\p{javaWhitespace}+|\p{javaWhitespace}+\z", "")


def normalize_sender(c) -> Column:
    """Trim, lower-case, then drop one leading ``@`` (no second trim)."""
    return F.regexp_replace(F.lower(trim_java(c)), "^@", "")


def sats_from_msat(c) -> Column:
    """Milli-satoshi to satoshi, truncating (non-negative domain)."""
    return (col_or_lit(c).cast("decimal(20,0)") / F.lit(1000)).cast("bigint")


def content_id(fields: dict[str, Column] | None = None) -> Column:
    """SHA-256 hex of the content fields joined by one space.

    ``fields`` maps a field name to the column carrying its *text* (default:
    the columns of the same name); a missing field contributes ``''``.  ``concat_ws`` skips NULLs, so every
    field is coalesced to ``''`` first.
    """
    parts = []
    for name in K.CONTENT_ID_FIELDS:
        if fields is None:
            c = F.col(name)
        else:
            c = fields.get(name, F.lit(None))
        parts.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.sha2(F.concat_ws(" ", *parts), 256)


def full_match(c, pattern: str) -> Column:
    """Java-regex full match (``rlike`` alone is a partial match).

    The pattern is a literal, so Spark compiles it once per task."""
    return col_or_lit(c).rlike(r"\A(?:" + pattern + r")\z")


def epoch_to_ntz(c) -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ holding the UTC wall clock (zone free)."""
    return F.timestamp_add("SECOND", col_or_lit(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def format_report_date(c) -> Column:
    """``yyyy/MM/dd h:mm:ss a zzz`` in Los Angeles time.

    ``date_format`` of a plain TIMESTAMP renders the session zone, so the wall
    clock is built as TIMESTAMP_NTZ and the abbreviation derived from the
    offset (7 h -> PDT, 8 h -> PST)."""
    utc = epoch_to_ntz(c)
    local = F.convert_timezone(F.lit("UTC"), F.lit(K.REPORT_ZONE), utc)
    offset = F.timestamp_diff("HOUR", local, utc)
    abbr = F.lit(None).cast("string")
    for hours, text in sorted(K.REPORT_ZONE_ABBREVIATIONS.items(), reverse=True):
        abbr = F.when(offset == hours, F.lit(text)).otherwise(abbr)
    return F.concat_ws(" ", F.date_format(local, K.REPORT_DATE_FORMAT), abbr)


def int_comma(c) -> Column:
    """C11: thousands separators, NULL -> ``0`` (exact, no float rounding)."""
    return F.format_number(F.coalesce(col_or_lit(c).cast("bigint"), F.lit(0).cast("bigint")), 0)


def split_lines(c) -> Column:
    r"""Split on ``\r?\n`` dropping trailing empty lines (Java ``split``)."""
    s = col_or_lit(c)
    stripped = F.regexp_replace(s, r"(\r?\n)+\z", "")
    return F.when((stripped == "") & (s != ""), F.array().cast("array<string>")) \
        .otherwise(F.split(stripped, r"\r?\n"))


def quote_lines(c, prefix: str = "> ") -> Column:
    """Prefix every line with a Markdown quote marker and join with newlines."""
    return F.array_join(F.transform(split_lines(c), lambda x: F.concat(F.lit(prefix), x)), "\n")


def digits_number(c) -> Column:
    """Keep digits only, parse as integer (leading zeros drop)."""
    return F.regexp_replace(col_or_lit(c), "[^0-9]", "").try_cast("bigint")


def epoch_of(c) -> Column:
    """TIMESTAMP -> epoch seconds (zone free)."""
    return F.unix_seconds(col_or_lit(c))


def relative_bound(as_of: int, seconds: int) -> int:
    """A lower bound ``seconds`` before ``as_of`` (two days, two weeks)."""
    return int(round(as_of - seconds))


def seconds_between(a, b) -> Column:
    """Whole seconds from instant ``a`` to instant ``b``."""
    return F.timestamp_diff("SECOND", col_or_lit(a), col_or_lit(b))


def per_30(cd="creation_date", action="action") -> Column:
    """I16 (dormant in the reference): 30-second bucket of a boost's time."""
    return F.when(col_or_lit(action) == F.lit(K.ACTION_BOOST),
                  F.floor(col_or_lit(cd) / F.lit(30)).cast("bigint"))


def utc_epoch(text: str) -> int:
    """A UTC wall-clock text ``yyyy-MM-dd HH:mm:ss`` as epoch seconds."""
    import calendar
    import time

    return calendar.timegm(time.strptime(text, "%Y-%m-%d %H:%M:%S"))


def utc_epoch_literal(text: str) -> Column:
    """A UTC wall-clock literal ``yyyy-MM-dd HH:mm:ss`` as epoch seconds."""
    return F.unix_timestamp(F.lit(text).cast("timestamp_ntz"))

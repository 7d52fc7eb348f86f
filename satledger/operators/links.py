"""Markdown link extraction (M1, M2).

``regexp_extract_all`` runs on the whole text of every document inside the
JVM; ``posexplode`` of the zipped group arrays gives one row per link in
order.  No text is truncated and nothing is collected."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import digits_number


def extract_links(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """M1: one row per Markdown link ``[text](target "title")``; the title is
    dropped.  ``pos`` is the 0-based position of the link in its text."""
    pat = F.lit(K.MARKDOWN_LINK_PATTERN)
    zipped = F.arrays_zip(F.regexp_extract_all(F.col(text), pat, 1).alias("text"),
                          F.regexp_extract_all(F.col(text), pat, 2).alias("link"))
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    return (df.select(*keep, F.posexplode(zipped).alias("pos", "l"))
            .select(*keep, "pos", F.col("l.text").alias("text"), F.col("l.link").alias("link")))


def episode_number(name: Column) -> Column:
    """Digits of a file name as a number (leading zeros drop)."""
    return digits_number(name)


def episode_links(docs: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """M2: links per file keyed by the episode number in the file name;
    order rows by ``(file_name, pos)`` for the listing."""
    with_ep = docs.withColumn("episode", episode_number(F.col(name)))
    return extract_links(with_ep, text)


def render_listing(links: DataFrame) -> DataFrame:
    """The listing text of each link row.  The reference prints with a
    multi-argument ``println``, which puts one space between arguments:
    ``+ [ text ]( link )``."""
    return links.withColumn("line", F.concat_ws(" ", F.lit("+ ["), F.col("text"), F.lit("]("),
                                                F.col("link"), F.lit(")")))


HEADING_POS = -1
BLANK_POS = 2_000_000_000


def listing_lines(docs: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """M2 output as ordered lines: per file (in name order) the heading
    ``##  <episode>``, one line per link, then an empty line.  Order by
    ``(file_name, pos)``; every file gets a heading, even without links."""
    with_ep = docs.withColumn("episode", episode_number(F.col(name)))
    heads = with_ep.select(F.col(name).alias("file_name"), "episode",
                           F.lit(HEADING_POS).cast("int").alias("pos"),
                           F.concat_ws(" ", F.lit(K.LISTING_HEADING),
                                       F.coalesce(F.col("episode").cast("string"), F.lit("")))
                           .alias("line"))
    blanks = with_ep.select(F.col(name).alias("file_name"), "episode",
                            F.lit(BLANK_POS).cast("int").alias("pos"), F.lit("").alias("line"))
    links = render_listing(extract_links(with_ep.withColumnRenamed(name, "file_name"), text)) \
        .select("file_name", "episode", F.col("pos").cast("int"), "line")
    return heads.unionByName(links).unionByName(blanks)


def ordered_listing(docs: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """The rows of :func:`listing_lines` in name order (missing names first)."""
    return listing_lines(docs, name, text).orderBy(F.col("file_name").asc_nulls_first(), "pos")


def write_listing(docs: DataFrame, path: str, name: str = "file_name", text: str = "text") -> None:
    """M2 sink: part files concatenated in name order are the listing."""
    ordered_listing(docs, name, text).select("line").write.mode("overwrite").text(path)

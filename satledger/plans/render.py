"""Markdown rendering of the show report (P1-P7) and the report sink.

The document is produced as *rows*: every row is a block of complete lines
plus the keys that place it.  Writing the rows sorted by those keys with
``write.text`` (one newline after each row) yields the exact document; the
sort is a range-partitioned global sort, so neither the driver nor a single
task ever holds the whole report.

Document layout (the reference's text, regrouped into blocks):

* section header ``## Baller Boosts`` / ``## Boosts`` / ``## Thanks``;
* per sender: ``### From: <sender>``, ``+ N sats``, ``+ N boosts``, then one
  block per boost (the first one names podcast, episode, app and source),
  then an empty line;
* an empty section is a single empty line;
* the summary block (boost, stream and overall totals, last seen id).
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import epoch_of, epoch_to_ntz, format_report_date, int_comma, quote_lines
from satledger.functions.predicates import tier_of
from satledger.operators import report as R
from satledger.session import cut_lineage

SECTIONS = list(zip([1, 2, 3], [K.TIER_BALLER, K.TIER_BOOST, K.TIER_THANKS],
                    K.REPORT_SECTION_TITLES))
SUMMARY_SECTION = 4
ORDER = ["section", "part", "k1", "k2", "kind", "t1", "t2", "t3"]


def _s(c) -> Column:
    """``str`` of a possibly missing value (NULL renders as empty)."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _boost_lines(is_first: Column) -> Column:
    when = F.concat(F.lit("+ "), format_report_date(F.col("creation_date")), F.lit(" ("),
                    F.col("creation_date").cast("string"), F.lit(")\n+ "),
                    int_comma(F.col("value_sat_total")), F.lit(K.REPORT_SATS_SUFFIX + "\n"),
                    quote_lines(F.coalesce(F.col("message"), F.lit(K.NO_MESSAGE)),
                                K.REPORT_QUOTE_PREFIX))
    head = F.concat(F.lit("+ "), _s("podcast"), F.lit("\n+ "), _s("episode"), F.lit("\n+ "),
                    _s("app_name"), F.lit("\n+ "), _s("source"), F.lit("\n\n"))
    return F.when(is_first, F.concat(head, when)).otherwise(F.concat(F.lit("\n"), when))


def _row(section, part, k1, k2, kind, t1, t2, t3, line) -> list[Column]:
    def lit(v, t):
        return v if isinstance(v, Column) else F.lit(v).cast(t)
    return [lit(section, "int").alias("section"), lit(part, "int").alias("part"),
            lit(k1, "bigint").alias("k1"), lit(k2, "string").alias("k2"),
            lit(kind, "int").alias("kind"), lit(t1, "bigint").alias("t1"),
            lit(t2, "string").alias("t2"), lit(t3, "string").alias("t3"),
            lit(line, "string").alias("line")]


def _section_no(tier: Column) -> Column:
    out = None
    for no, name, _ in SECTIONS:
        out = F.when(tier == name, F.lit(no)) if out is None else out.when(tier == name, F.lit(no))
    return out


WINDOW_COLUMNS = ["sender_name_normalized", "action", "creation_date", "created_at", "source", "identifier",
                  "value_sat_total", "podcast", "episode", "app_name", "message"]


def report_lines(inv: DataFrame, pattern: str, since: int,
                 excluded: Iterable[str] | None = None, materialize: bool = True) -> DataFrame:
    """The rendered report as ordered line blocks (see module doc).

    With ``materialize`` the projected report window and the per-sender
    aggregate are written once to the shared checkpoint folder; every block
    type is then derived from those two, instead of re-reading and
    re-filtering the source for each branch of the union."""
    valid = R.valid_invoices(inv, pattern, since, excluded)
    cutoff = R.report_cutoff(valid).scalar()
    window = valid.filter(F.col("creation_date") <= cutoff).select(*WINDOW_COLUMNS)
    if materialize:
        window = cut_lineage(window)
    per = R.per_sender(window)
    if materialize:
        per = cut_lineage(per)
    spark = inv.sparkSession

    senders = (per.filter(F.col("boost_count") > 0)
               .select("sender", F.col("boost_sats").alias("total_sats"), "boost_count",
                       "first_boost", "first_key", tier_of("boost_sats").alias("tier"))
               .withColumn("section", _section_no(F.col("tier")))
               .withColumn("k1", F.when(F.col("tier") == K.TIER_BALLER, -F.col("total_sats"))
                           .otherwise(F.col("first_boost"))))

    headers = spark.range(1).select(F.explode(F.array(*[
        F.struct(*_row(no, 0, None, None, 0, None, None, None, title))
        for no, _, title in SECTIONS])).alias("r")).select("r.*")

    head = F.struct(*_row(
        F.col("section"), 1, F.col("k1"), F.col("sender"), 0, None, None, None,
        F.concat(F.lit(K.REPORT_SENDER_HEADING), F.col("sender"), F.lit("\n+ "),
                 int_comma("total_sats"), F.lit(K.REPORT_SATS_SUFFIX + "\n+ "),
                 int_comma("boost_count"), F.lit(K.REPORT_BOOSTS_SUFFIX))))
    tail = F.struct(*_row(F.col("section"), 1, F.col("k1"), F.col("sender"), 2,
                          None, None, None, ""))
    sender_rows = senders.select(F.explode(F.array(head, tail)).alias("r")).select("r.*")

    boosts = window.filter((F.col("action") == K.ACTION_BOOST)
                           & F.col("sender_name_normalized").isNotNull()
                           & F.col("value_sat_total").isNotNull())
    d = boosts.join(senders.select("sender", "section", "k1", "first_key"),
                    boosts["sender_name_normalized"] == senders["sender"], "inner")
    is_first = F.struct("created_at", "source", "identifier") == F.col("first_key")
    boost_rows = d.select(*_row(F.col("section"), 1, F.col("k1"), F.col("sender"), 1,
                                epoch_of("created_at"), F.col("source"), F.col("identifier"),
                                _boost_lines(is_first)))

    present = senders.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    all_sections = spark.createDataFrame([(no,) for no, _, _ in SECTIONS], "section int")
    empty = (F.broadcast(all_sections).join(present, "section", "left_anti")
             .select(*_row(F.col("section"), 2, None, None, 0, None, None, None, "")))

    s = R.summary_from_per_sender(per)
    values = [["boost_total_sats", "boost_total_boosts", "boost_total_boosters"],
              ["stream_total_sats", "stream_total_streams", "stream_total_streamers"],
              ["total_sats", "total_invoices", "total_unique_senders"],
              ["last_seen_id"]]
    parts = []
    for (title, labels), cols in zip(K.REPORT_SUMMARY_BLOCKS, values):
        if parts:
            parts.append(F.lit("\n\n"))
        parts.append(F.lit(title))
        for label, c in zip(labels, cols):
            shown = _s(c) if c == "last_seen_id" else int_comma(c)
            parts += [F.lit("\n" + label), shown]
    summary = s.select(*_row(SUMMARY_SECTION, 0, None, None, 0, None, None, None, F.concat(*parts)))

    return (headers.unionByName(sender_rows).unionByName(boost_rows)
            .unionByName(empty).unionByName(summary))


def ordered(lines: DataFrame) -> DataFrame:
    """Global order of the blocks (nulls first, as headers carry no keys)."""
    return lines.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])


def write_report(lines: DataFrame, path: str) -> None:
    """Write the document; part files concatenated in name order are the
    report.  Only aggregated report rows are written, never raw invoices."""
    ordered(lines).select("line").write.mode("overwrite").text(path)


def boost_blocks(rows: DataFrame) -> DataFrame:
    """One flat text block per payment (indented quote, missing message
    gives one empty quote line), with its event time for ordering (O13)."""
    created = F.date_format(epoch_to_ntz("creation_date"), "EEE MMM dd HH:mm:ss 'UTC' yyyy")
    text = F.concat(
        F.lit(K.FLAT_SENDER_HEADING), _s("sender_name_normalized"),
        F.lit("\n + "), int_comma("value_sat_total"), F.lit(K.REPORT_SATS_SUFFIX),
        F.lit("\n + "), _s("podcast"), F.lit(" / "), _s("episode"),
        F.lit("\n + "), _s("app_name"), F.lit(" "), created, F.lit(" ("),
        F.col("creation_date").cast("string"), F.lit(")"),
        F.lit("\n + "), _s("source"), F.lit("\n"),
        quote_lines(F.coalesce(F.col("message"), F.lit("")), K.FLAT_QUOTE_PREFIX), F.lit("\n"))
    return rows.select("creation_date", "source", "identifier", text.alias("block"))


def ordered_boosts(rows: DataFrame) -> DataFrame:
    """The blocks of :func:`boost_blocks` by event time,
    equal times by source and identifier."""
    return boost_blocks(rows).orderBy("creation_date", "source", "identifier")


def write_boosts(rows: DataFrame, path: str) -> None:
    """O13 sink: part files concatenated in name order are the blocks in order."""
    ordered_boosts(rows).select("block").write.mode("overwrite").text(path)

"""Raw upstream pages derived from the invoice table (Spark-side).

The driver data carries no payment pages, so the ingest path is exercised by
encoding adapter invoices back into the two upstream layouts: node pages
(base64 JSON boostagram in the first HTLC's custom records, string epochs,
``add_index``) and wallet pages (JSON array, integer epoch, ISO ``created_at``,
inline ``boostagram`` object).  Pages group a bounded id range of one source
(at most ``3 * page_size`` invoices), so no group is unbounded.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import epoch_to_ntz

BOOST_KEYS = ["action", "app_name", "podcast", "episode", "sender_name", "message",
              "value_msat_total"]
NODE_SOURCES = ["node_a", "node_b"]
WALLET_SOURCES = ["wallet"]


def _boost(inv: DataFrame):
    return F.struct(*[F.col(c) for c in BOOST_KEYS])


def node_invoice_json(inv: DataFrame, corrupt_every: int | None = None) -> DataFrame:
    """One node invoice JSON text per row (``source``, ``page``, ``raw``)."""
    payload = F.base64(F.encode(F.to_json(_boost(inv)), "UTF-8"))
    if corrupt_every:
        bad = F.col("identifier").cast("bigint") % corrupt_every == 0
        payload = F.when(bad, F.concat(F.lit("@@@"), payload)).otherwise(payload)
    rec = F.create_map(F.lit(K.BOOSTAGRAM_TLV), payload)
    htlcs = F.array(F.struct(rec.alias("custom_records")))
    body = F.struct(
        F.col("identifier").alias("add_index"),
        F.col("creation_date").cast("string").alias("creation_date"),
        F.lit("SETTLED").alias("state"),
        htlcs.alias("htlcs"),
        F.struct(F.lit(True).alias("is_known")).alias("features"),
    )
    return inv.select("source", "identifier", F.to_json(body).alias("raw"))


def wallet_invoice_json(inv: DataFrame) -> DataFrame:
    """One wallet invoice JSON text per row."""
    created = F.date_format(epoch_to_ntz("creation_date"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.struct(
        F.col("identifier").alias("identifier"),
        F.col("creation_date").alias("creation_date"),
        created.alias("created_at"),
        F.concat(F.lit("memo "), F.col("identifier")).alias("memo"),
        _boost(inv).alias("boostagram"),
        F.struct(F.lit("x").alias("k")).alias("metadata"),
    )
    return inv.select("source", "identifier", F.to_json(body).alias("raw"))


#: Pages of a source that lie in one landed file, unless that leaves fewer than ``FILES`` files.
PAGES_PER_FILE = 2000
FILES = 8


def _pages(rows: DataFrame, page_size: int, wrap) -> DataFrame:
    """Group invoice texts into pages by a contiguous numeric id range of one
    source: ``3 * page_size`` ids per range, so with the adapter's layout
    (source = id mod 3) a page holds ``page_size`` invoices, and never more
    than ``3 * page_size`` for any layout - a bounded group.

    Pages are dealt by runs of consecutive ones: written as they lie, their files grow with the
    pages up to a size and then in number, whatever the number of shuffle partitions."""
    page = F.floor(F.col("identifier").cast("bigint") / F.lit(page_size * 3)).cast("bigint")
    rows = rows.withColumn("page", page)
    first, last = rows.agg(F.min("page"), F.max("page")).first()
    pages = 1 if last is None else last - first + 1
    run = F.floor(F.col("page") / F.lit(max(1, min(PAGES_PER_FILE, -(-pages // FILES))))).cast("bigint")
    grouped = rows.withColumn("run", run).repartition("source", "run").groupBy("source", "run", "page").agg(
        F.sort_array(F.collect_list(F.struct(F.col("identifier").cast("bigint").alias("i"),
                                             F.col("raw")))).alias("items"))
    return grouped.select("source", "page", wrap(F.transform("items", lambda x: x["raw"])).alias("value"))


def node_pages(inv: DataFrame, page_size: int = 100, corrupt_every: int | None = None) -> DataFrame:
    rows = node_invoice_json(inv.filter(F.col("source").isin(NODE_SOURCES)), corrupt_every)

    def wrap(texts):
        # The page document is assembled as text so each invoice stays verbatim.
        return F.concat(F.lit('{"first_index_offset":"0","invoices":['),
                        F.array_join(texts, ","), F.lit("]}"))
    return _pages(rows, page_size, wrap)


def wallet_pages(inv: DataFrame, page_size: int = 100) -> DataFrame:
    rows = wallet_invoice_json(inv.filter(F.col("source").isin(WALLET_SOURCES)))

    def wrap(texts):
        return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    return _pages(rows, page_size, wrap)

"""Adapter: the driver's ``events`` table -> the normalised ``invoices`` store.

The test data has no payment pages, so each event is mapped to one invoice by
fixed rules (see FIXTURES.md section 6).  It is one narrow projection over the
scan: no shuffle, no Python.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satledger import schemas
from satledger.functions.columns import content_id, normalize_sender, sats_from_msat
from satledger.session import table_path

# --- fixed values of the adapter rules ---------------------------------------
SOURCE_BY_REMAINDER = {0: "wallet", 1: "node_a", 2: "node_b"}        # event_id % 3
ACTION_BY_EVENT = {"purchase": "boost", "view": "stream", "click": "stream",
                   "signup": "auto"}                                  # error -> NULL
PODCAST_BY_REMAINDER = {0: "Alpha Unplugged", 1: "Beta Coder", 2: "Gamma Hosted",
                        3: "Delta Bitcoin"}                           # k % 5, 4 -> NULL
MSAT_PER_VALUE = 60000


def _case(expr, mapping: dict):
    out = None
    for k, v in mapping.items():
        out = (F.when(expr == F.lit(k), F.lit(v)) if out is None
               else out.when(expr == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(None).cast("string"))


def events_to_invoices(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    eid = F.col("event_id")
    uid = F.col("user_id")
    cd = F.unix_timestamp("ts")
    sender = F.when(uid % 37 == 0, F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit(" @User_"), uid.cast("string"), F.lit(" ")))
    msat = F.round(F.col("value") * MSAT_PER_VALUE).cast("bigint") + eid % 1000
    base = events.select(
        _case(eid % 3, SOURCE_BY_REMAINDER).alias("source"),
        eid.cast("string").alias("identifier"),
        cd.alias("creation_date"),
        _case(F.col("event_type"), ACTION_BY_EVENT).alias("action"),
        sender.alias("sender_name"),
        _case(k % 5, PODCAST_BY_REMAINDER).alias("podcast"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Episode "), (k % 10).cast("string"))).alias("episode"),
        F.when(k % 6 == 5, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("app_"), (k % 6).cast("string"))).alias("app_name"),
        msat.alias("value_msat_total"),
        F.when(eid % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("msg "), eid.cast("string"),
                             F.when(eid % 5 == 0, F.lit("\nmore")).otherwise(F.lit("")))).alias("message"),
        # up to ten minutes from the event time, in another order
        F.timestamp_seconds(cd + (eid * 7919) % 1201 - 600).alias("created_at"),
    )
    null_s = F.lit(None).cast("string")
    cols = {
        "source": F.col("source"),
        "identifier": F.col("identifier"),
        "invoice_source": null_s,
        "creation_date": F.col("creation_date"),
        "created_at": F.col("created_at"),
        "add_index": F.lit(None).cast("bigint"),
        "comment": null_s, "memo": null_s, "keysend": null_s,
        "action": F.col("action"), "app_name": F.col("app_name"),
        "podcast": F.col("podcast"), "episode": F.col("episode"),
        "sender_name": F.col("sender_name"),
        "sender_name_normalized": normalize_sender("sender_name"),
        "message": F.col("message"),
        "value_msat_total": F.col("value_msat_total"),
        "value_sat_total": sats_from_msat("value_msat_total"),
        "ts": null_s, "time": null_s, "guid": null_s, "feedID": null_s, "itemID": null_s,
        "episode_guid": null_s, "boost_uuid": null_s,
        "content_id": content_id({n: F.col(n) for n in
                                  ["action", "episode", "podcast", "sender_name",
                                   "value_msat_total", "message", "app_name"]}),
        "extra": F.lit(None).cast("map<string,string>"),
    }
    return base.select(*[cols[n].alias(n) for n in schemas.INVOICE_COLUMNS])


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "events"))


def load_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter over ``sf_dir/events.parquet``."""
    return events_to_invoices(load_events(spark, sf_dir))

"""Test helpers: hand-built invoice rows with derived columns filled in."""
from __future__ import annotations

import base64
import json

from pyspark.sql import functions as F

from satledger.functions.columns import content_id, normalize_sender, sats_from_msat
from satledger.schemas import INVOICES, INVOICE_COLUMNS


def invoices(spark, rows: list[dict]):
    """Rows need ``source``, ``identifier``, ``creation_date``; the rest is
    optional.  Normalised sender, sats, created_at and content id are derived."""
    full = []
    for r in rows:
        d = {c: None for c in INVOICE_COLUMNS}
        d.update(r)
        full.append(tuple(d[c] for c in INVOICE_COLUMNS))
    df = spark.createDataFrame(full, INVOICES)
    return (df.withColumn("sender_name_normalized", normalize_sender("sender_name"))
              .withColumn("value_sat_total", sats_from_msat("value_msat_total"))
              .withColumn("created_at", F.timestamp_seconds("creation_date"))
              .withColumn("content_id", content_id())
              .select(*INVOICE_COLUMNS))


def boost(i, cd, sender, sats, action="boost", podcast="Alpha Unplugged", episode="Episode 1",
          source="node_a", message=None, app="app_1"):
    return {"source": source, "identifier": str(i), "creation_date": cd, "action": action,
            "sender_name": sender, "value_msat_total": sats * 1000, "podcast": podcast,
            "episode": episode, "message": message, "app_name": app}


def b64(text: str) -> str:
    return base64.b64encode(text.encode("utf-8")).decode("ascii")


def node_invoice(add_index: str, creation_date, payload: str | None = None, keysend: str | None = None,
                 htlcs: bool = True, **extra) -> str:
    records = {}
    if payload is not None:
        records["7629169"] = payload
    if keysend is not None:
        records["34349334"] = keysend
    body = {"add_index": add_index, "creation_date": creation_date,
            "htlcs": [{"custom_records": records}] if htlcs else [], **extra}
    return json.dumps(body)


def boostagram(**fields) -> str:
    return b64(json.dumps(fields))

"""Explicit schemas: raw upstream pages (bronze) and the normalised store."""
from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()

# Fields of the normalised ``invoices`` store, in storage order.
INVOICE_FIELDS = [
    ("source", S), ("identifier", S), ("invoice_source", S),
    ("creation_date", L), ("created_at", T.TimestampType()), ("add_index", L),
    ("comment", S), ("memo", S), ("keysend", S),
    ("action", S), ("app_name", S), ("podcast", S), ("episode", S),
    ("sender_name", S), ("sender_name_normalized", S), ("message", S),
    ("value_msat_total", L), ("value_sat_total", L),
    ("ts", S), ("time", S), ("guid", S), ("feedID", S), ("itemID", S),
    ("episode_guid", S), ("boost_uuid", S),
    ("content_id", S), ("extra", T.MapType(S, S)),
]
INVOICES = T.StructType([T.StructField(n, t, True) for n, t in INVOICE_FIELDS])
INVOICE_COLUMNS = [n for n, _ in INVOICE_FIELDS]
KEY = ["source", "identifier"]

# Boostagram scalar fields kept as typed columns; any other key goes to ``extra``.
BOOSTAGRAM_STRING_FIELDS = [
    "action", "app_name", "podcast", "episode", "sender_name", "message",
    "ts", "time", "guid", "feedID", "itemID", "episode_guid", "boost_uuid",
]
BOOSTAGRAM_FIELDS = BOOSTAGRAM_STRING_FIELDS + ["value_msat_total"]

# Top-level invoice scalars kept as typed columns (I1 drops the rest of the
# known noise; everything else lands in ``extra``).
DROPPED_INVOICE_KEYS = ["features", "amp_invoice_state", "metadata", "custom_records"]
KNOWN_INVOICE_KEYS = ["identifier", "source", "creation_date", "created_at", "add_index",
                      "comment", "memo", "keysend", "htlcs", "boostagram"]

HTLCS = T.ArrayType(T.StructType([T.StructField("custom_records", T.MapType(S, S), True)]))

# A node page: {"first_index_offset": "...", "invoices": [ {...}, ... ]}.
# Each invoice is kept as raw JSON text so the open schema survives.
NODE_PAGE = T.StructType([
    T.StructField("first_index_offset", S, True),
    T.StructField("last_index_offset", S, True),
    T.StructField("invoices", T.ArrayType(S), True),
])

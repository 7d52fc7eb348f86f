"""Fixed values that must equal the reference behaviour for identical results.

These are stated plainly, in natural order, in one place.
"""
import hashlib

# --- fixed values: custom-record TLV types carrying payment metadata ---------
BOOSTAGRAM_TLV = "7629169"
KEYSEND_TLV = "34349334"

# --- fixed values: time constants (epoch seconds) ----------------------------
AUTOSCRAPE_START = 1725148800          # 2024-09-01T00:00:00Z, cursor of an empty store
RECONCILE_LOOKBACK = 3600              # reconcile lower bound = start - one hour
HOLD_BACK_SECONDS = 600                # source-side grace window of reconcile
TWO_DAYS_SECONDS = 2 * 24 * 60 * 60    # relative lower bound, ingest helper
TWO_WEEKS_SECONDS = 2 * 7 * 24 * 60 * 60  # default report window
POLL_INTERVAL = "60 seconds"           # ingest cycle
POLL_SECONDS = 60
LEADERBOARD_SINCE = "2024-01-01 00:00:00"     # UTC, action leaderboards
ALL_ACTIONS_SINCE = "2023-01-01 00:00:00"     # UTC, leaderboard over all actions

# --- fixed values: spending tiers (sats, on a sender's total) ----------------
BALLER_MIN_SATS = 20000
BOOST_MIN_SATS = 2000
TIER_BALLER = "baller"
TIER_BOOST = "boost"
TIER_THANKS = "thanks"

# --- fixed values: defaults for missing attributes ---------------------------
UNKNOWN_EPISODE = "Unknown Episode"
UNKNOWN_APP = "unknown_app"
MISSING_SENDER = "N/A"
NO_MESSAGE = "No Message Found :("

# --- fixed values: report text (Markdown), in document order -----------------
REPORT_SECTION_TITLES = ["## Baller Boosts", "## Boosts", "## Thanks"]
REPORT_SENDER_HEADING = "### From: "
REPORT_SATS_SUFFIX = " sats"
REPORT_BOOSTS_SUFFIX = " boosts"
REPORT_QUOTE_PREFIX = "> "
REPORT_SUMMARY_BLOCKS = [
    ("## Boost Summary", ["+ Total Boosted Sats: ", "+ Total Boosts: ", "+ Total Boosters: "]),
    ("## Stream Summary", ["+ Total Streamed Sats: ", "+ Total Streams: ", "+ Total Streamers: "]),
    ("## Summary", ["+ Total Sats: ", "+ Total Invoices: ", "+ Total Unique Senders: "]),
    ("## Last Seen", ["+ Last seen ID: "]),
]
FLAT_SENDER_HEADING = "### From: "
FLAT_QUOTE_PREFIX = "   > "
LISTING_HEADING = "## "

# --- fixed values: report date format ----------------------------------------
REPORT_ZONE = "America/Los_Angeles"
REPORT_DATE_FORMAT = "yyyy/MM/dd h:mm:ss a"
REPORT_ZONE_ABBREVIATIONS = {7: "PDT", 8: "PST"}   # UTC offset in hours -> text

# --- fixed values: content-id field order (joined by one space, SHA-256) ----
CONTENT_ID_FIELDS = [
    "action", "episode", "episode_guid", "itemID", "podcast", "guid", "feedID",
    "sender_name", "value_msat_total", "boost_uuid", "message", "app_name",
    "ts", "time",
]

# Content id of an invoice without any content field (every plain invoice):
# the hash of the field separators alone - derived from the rule above.
PLAIN_CONTENT_ID = hashlib.sha256(
    (" " * (len(CONTENT_ID_FIELDS) - 1)).encode("utf-8")).hexdigest()

# --- fixed values: Markdown link pattern (text, target, optional title) -----
MARKDOWN_LINK_PATTERN = r'\[(.+?)\]\((.+?)(?: "(.+?)")?\)'

# --- actions ------------------------------------------------------------------
ACTION_BOOST = "boost"
ACTION_STREAM = "stream"

# Upstream names used by the test adapter and the sample job.
SOURCES = ["wallet", "node_a", "node_b"]

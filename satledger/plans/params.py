"""Parameters of the registered queries (fixed up front, shared by the Spark
callables and the oracle SQL so both sides ask the same question)."""

# Shows over the fixture's own podcasts (name -> Java regex, full match).
SHOWS = {
    "All": ".*",
    "Alpha": "(?i)alpha .*",
    "Beta": "(?i)beta .*",
    "Gamma or Delta": "(Gamma|Delta) .*",
}
SHOW_PATTERN = "Alpha .*"     # fixed show pattern of the legacy and leaderboard queries
SINCE_A = 1704067200          # 2024-01-01T00:00:00Z
SINCE_B = 1705363200          # 2024-01-16T00:00:00Z
AS_OF = 1706659200            # 2024-01-31T00:00:00Z
EXCLUDED = ["user_5", "user_8"]
LAST_SEEN_SOURCE = "wallet"
LAST_SEEN_ID = "300"
LEGACY_LITERAL = "Delta Bitcoin"
BOARD_LITERAL = "Alpha Unplugged"
ALL_ACTIONS_PATTERN = "Episode [0-2]"
SIMILAR_DELTA = 600
TOP_K = 15
SHARED_EVERY = 4              # reconcile fixture: event_id % 4 = 0 is also known to the next source
BALLER_SCALE = 20             # per-row baller query: amounts times this
NESTING = 20                  # levels of the open-schema fixture
PATCH_EVERY = 10              # upsert fixture: event_id % 10 = 0 gets a second version
DELETE_EVERY = 7              # delete fixture: event_id % 7 = 0 is retracted
CORRUPT_EVERY = 13            # decode fixture: event_id % 13 = 0 carries a broken payload
SIMILAR_ACTION = "boost"
SIMILAR_SENDER = "user_7"
SIMILAR_AT = 1705363200
SIMILAR_WINDOW = 86400
LOOKUP_ID = "4242"
PAGE_IDS = 300                # page fixture: ids per page
TIMELESS_PAGES = 5            # every fifth page has no event times
REPORT_RUNS = (SINCE_B, SINCE_B + 7 * 86400, AS_OF)   # what each report run sees: payments before
REPORT_SHOWS = ("Alpha", "All")
PAGES_PER_FILE = 20           # Markdown fixture

"""DuckDB oracle SQL for the catalogue (same parameters, same column names).

Each statement starts from the adapter written in plain SQL over the
``events`` view, so the oracle shares no code with the Spark side."""
from __future__ import annotations

from satledger import constants as K
from satledger.plans import params as P

SHOWS = P.SHOWS
EXCL = ", ".join(f"'{n}'" for n in P.EXCLUDED)

ADAPTER = """
ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events),
base AS (
  SELECT
    CASE event_id % 3 WHEN 0 THEN 'wallet' WHEN 1 THEN 'node_a' ELSE 'node_b' END AS source,
    CAST(event_id AS VARCHAR) AS identifier,
    event_id,
    CAST(floor(epoch(ts)) AS BIGINT) AS creation_date,
    CASE event_type WHEN 'purchase' THEN 'boost' WHEN 'view' THEN 'stream'
                    WHEN 'click' THEN 'stream' WHEN 'signup' THEN 'auto' END AS action,
    CASE WHEN user_id % 37 = 0 THEN NULL ELSE ' @User_' || CAST(user_id AS VARCHAR) || ' ' END AS sender_name,
    CASE WHEN user_id % 37 = 0 THEN NULL ELSE 'user_' || CAST(user_id AS VARCHAR) END AS sender_name_normalized,
    CASE k % 5 WHEN 0 THEN 'Alpha Unplugged' WHEN 1 THEN 'Beta Coder'
               WHEN 2 THEN 'Gamma Hosted' WHEN 3 THEN 'Delta Bitcoin' END AS podcast,
    CASE WHEN k % 7 = 0 THEN NULL ELSE 'Episode ' || CAST(k % 10 AS VARCHAR) END AS episode,
    CASE WHEN k % 6 = 5 THEN NULL ELSE 'app_' || CAST(k % 6 AS VARCHAR) END AS app_name,
    CAST(round(value * 60000) AS BIGINT) + event_id % 1000 AS value_msat_total,
    CAST(floor(epoch(ts)) AS BIGINT) + (event_id * 7919) % 1201 - 600 AS created_epoch,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'msg ' || CAST(event_id AS VARCHAR)
         || CASE WHEN event_id % 5 = 0 THEN chr(10) || 'more' ELSE '' END END AS message
  FROM ev),
invoices AS (
  SELECT *, value_msat_total // 1000 AS value_sat_total,
    sha256(concat_ws(' ', coalesce(action, ''), coalesce(episode, ''), '', '', coalesce(podcast, ''),
                     '', '', coalesce(sender_name, ''), coalesce(CAST(value_msat_total AS VARCHAR), ''),
                     '', coalesce(message, ''), coalesce(app_name, ''), '', '')) AS content_id
  FROM base)
"""


def q(*ctes: str, select: str) -> str:
    body = ",\n".join([ADAPTER.strip()] + [c.strip() for c in ctes])
    return f"WITH {body}\n{select.strip()}"


def show_pred(pattern: str) -> str:
    return (f"podcast IS NOT NULL AND (regexp_full_match(podcast, '{pattern}') OR "
            f"regexp_full_match(coalesce(episode, 'Unknown Episode'), '{pattern}'))")


def valid_cte(pattern: str, since: int, name: str = "valid") -> str:
    return f"""{name} AS (SELECT * FROM invoices WHERE creation_date > {since}
      AND NOT coalesce(sender_name_normalized IN ({EXCL}), false) AND {show_pred(pattern)})"""


def window_ctes(pattern: str, since: int) -> list[str]:
    return [
        valid_cte(pattern, since),
        "cut AS (SELECT max(creation_date) AS cutoff FROM valid WHERE action = 'boost')",
        "win AS (SELECT valid.* FROM valid, cut WHERE valid.creation_date <= cut.cutoff)",
        """counted AS (SELECT * FROM win WHERE sender_name_normalized IS NOT NULL
             AND value_sat_total IS NOT NULL)""",
    ]


def tier(expr: str) -> str:
    return (f"CASE WHEN {expr} >= {K.BALLER_MIN_SATS} THEN 'baller' "
            f"WHEN {expr} >= {K.BOOST_MIN_SATS} THEN 'boost' ELSE 'thanks' END")


SENDERS_SELECT = f"""
SELECT sender_name_normalized AS sender, CAST(sum(value_sat_total) AS BIGINT) AS total_sats,
       count(*) AS boost_count, min(creation_date) AS first_boost,
       {tier('sum(value_sat_total)')} AS tier
FROM counted WHERE action = 'boost' GROUP BY sender_name_normalized"""

SUMMARY_SELECT = """
SELECT CAST(coalesce(sum(value_sat_total) FILTER (WHERE action = 'boost'), 0) AS BIGINT) AS boost_total_sats,
       count(*) FILTER (WHERE action = 'boost') AS boost_total_boosts,
       count(DISTINCT sender_name_normalized) FILTER (WHERE action = 'boost') AS boost_total_boosters,
       CAST(coalesce(sum(value_sat_total) FILTER (WHERE action = 'stream'), 0) AS BIGINT) AS stream_total_sats,
       count(*) FILTER (WHERE action = 'stream') AS stream_total_streams,
       count(DISTINCT sender_name_normalized) FILTER (WHERE action = 'stream') AS stream_total_streamers,
       CAST(coalesce(sum(value_sat_total), 0) AS BIGINT) AS total_sats,
       count(*) AS total_invoices,
       count(DISTINCT sender_name_normalized) AS total_unique_senders,
       (SELECT cutoff FROM cut) AS last_seen_id
FROM counted"""

FLAT_COLS = """source, identifier, CAST(NULL AS VARCHAR) AS invoice_source, creation_date,
  CAST(NULL AS BIGINT) AS add_index, CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS memo,
  CAST(NULL AS VARCHAR) AS keysend, action, app_name, podcast, episode, sender_name,
  sender_name_normalized, message, value_msat_total, value_sat_total,
  CAST(NULL AS VARCHAR) AS ts, CAST(NULL AS VARCHAR) AS time, CAST(NULL AS VARCHAR) AS guid,
  CAST(NULL AS VARCHAR) AS feedID, CAST(NULL AS VARCHAR) AS itemID,
  CAST(NULL AS VARCHAR) AS episode_guid, CAST(NULL AS VARCHAR) AS boost_uuid, content_id,
  created_epoch"""


def board_sql(action: str | None, since: str, pattern: str, literal: str) -> str:
    act = f"action = '{action}'" if action else "action IS NOT NULL"
    return f"""board AS (
  SELECT coalesce(sender_name_normalized, 'N/A') AS sender, action, count(*) AS n,
         CAST(CAST(sum(value_msat_total) AS DECIMAL(38,0)) / 1000 AS DECIMAL(38,3)) AS amount
  FROM invoices
  WHERE created_epoch >= CAST(epoch(TIMESTAMP '{since}') AS BIGINT) AND {act}
    AND value_msat_total IS NOT NULL AND episode IS NOT NULL AND podcast IS NOT NULL
    AND (regexp_full_match(episode, '{pattern}') OR podcast = '{literal}')
  GROUP BY 1, 2)"""


def top_sql(action: str, by: str) -> str:
    return q(board_sql(action, K.LEADERBOARD_SINCE, P.SHOW_PATTERN, P.BOARD_LITERAL),
             select=f"SELECT * FROM board ORDER BY {by} DESC, sender, action LIMIT {P.TOP_K}")


ALL_BOARD = board_sql(None, K.ALL_ACTIONS_SINCE, P.ALL_ACTIONS_PATTERN, P.LEGACY_LITERAL)

SPLIT = [
    f"""shared AS (SELECT * REPLACE ('node_b' AS source, 'copy ' || identifier AS identifier) FROM invoices
          WHERE source <> 'node_b' AND event_id % {P.SHARED_EVERY} = 0)""",
    "dest AS (SELECT * FROM invoices WHERE source = 'node_b' UNION ALL SELECT * FROM shared)",
    "src AS (SELECT * FROM invoices WHERE source <> 'node_b')",
    f"""dest_ids AS (SELECT DISTINCT content_id FROM dest
          WHERE creation_date > {P.SINCE_A} AND creation_date < {P.AS_OF})""",
    f"""src_ids AS (SELECT DISTINCT content_id FROM src
          WHERE creation_date > {P.SINCE_A} AND creation_date < {P.AS_OF - K.HOLD_BACK_SECONDS})""",
    "missing AS (SELECT content_id FROM src_ids EXCEPT SELECT content_id FROM dest_ids)",
]

LAST_SEEN = (f"(SELECT min(creation_date) FROM invoices WHERE identifier = '{P.LAST_SEEN_ID}' "
             f"AND source = '{P.LAST_SEEN_SOURCE}')")
LEGACY_BASE = f"""legacy AS (SELECT * FROM invoices WHERE creation_date > {LAST_SEEN}
  AND action = 'boost' AND podcast IS NOT NULL
  AND (regexp_full_match(podcast, '{P.SHOW_PATTERN}') OR podcast = '{P.LEGACY_LITERAL}'))"""
LEGACY_COLS = ("app_name, podcast, episode, sender_name_normalized, value_sat_total, message, "
               "source, identifier, created_epoch")
STREAM_WIN = f"""sw AS (SELECT * FROM invoices WHERE creation_date > {LAST_SEEN}
  AND action = 'stream' AND {show_pred(SHOWS['Beta'])}
  AND value_sat_total IS NOT NULL AND sender_name_normalized IS NOT NULL)"""

PATCHED = f"""
patched AS (
  SELECT source, identifier, 'patched' AS app_name, CAST(NULL AS VARCHAR) AS message, value_msat_total,
    sha256(concat_ws(' ', coalesce(action, ''), coalesce(episode, ''), '', '', coalesce(podcast, ''),
                     '', '', coalesce(sender_name, ''), coalesce(CAST(value_msat_total AS VARCHAR), ''),
                     '', '', 'patched', '', '')) AS content_id
  FROM invoices WHERE event_id % {P.PATCH_EVERY} = 0)"""

SQL: dict[str, str] = {
    "invoices_adapter": q(select=f"SELECT {FLAT_COLS} FROM invoices"),
    "content_ids": q(select="SELECT source, identifier, content_id FROM invoices"),
    "sender_normalized": q(select="SELECT source, identifier, sender_name, sender_name_normalized FROM invoices"),
    "valid_invoices": q(valid_cte(SHOWS["Alpha"], P.SINCE_B),
                        select="SELECT source, identifier, creation_date, action, sender_name_normalized FROM valid"),
    "report_rows": q(valid_cte(SHOWS["Alpha"], P.SINCE_A), select="""
        SELECT source, identifier, created_epoch, creation_date, content_id,
               value_sat_total, sender_name_normalized, podcast, episode, app_name, message
        FROM valid WHERE action = 'boost'"""),
    "report_cutoff": q(valid_cte(SHOWS["Alpha"], P.SINCE_A),
                       select="SELECT max(creation_date) AS cutoff FROM valid WHERE action = 'boost'"),
    "report_senders": q(*window_ctes(SHOWS["All"], P.SINCE_A), select=SENDERS_SELECT),
    "report_senders_unplugged": q(*window_ctes(SHOWS["Alpha"], P.SINCE_B), select=SENDERS_SELECT),
    "report_sender_details": q(*window_ctes(SHOWS["Alpha"], P.SINCE_B), select="""
        SELECT sender_name_normalized AS sender, creation_date, created_epoch, source,
               identifier, value_sat_total, podcast, episode, app_name, message,
               row_number() OVER (PARTITION BY sender_name_normalized
                                  ORDER BY creation_date, source, identifier) = 1 AS is_first
        FROM counted WHERE action = 'boost'"""),
    "report_summary": q(*window_ctes(SHOWS["All"], P.SINCE_A), select=SUMMARY_SELECT),
    "report_summary_unplugged": q(*window_ctes(SHOWS["Alpha"], P.SINCE_B), select=SUMMARY_SELECT),
    "leaderboard_boost_by_amount": top_sql("boost", "amount"),
    "leaderboard_boost_by_count": top_sql("boost", "n"),
    "leaderboard_stream_by_amount": top_sql("stream", "amount"),
    "leaderboard_stream_by_count": top_sql("stream", "n"),
    "leaderboard_all_actions": q(ALL_BOARD, select="SELECT * FROM board"),
    "leaderboard_totals": q(ALL_BOARD, select="""
        SELECT action, CAST(sum(floor(amount)) AS BIGINT) AS total_amount,
               CAST(sum(n) AS BIGINT) AS total_count, count(*) AS senders
        FROM board GROUP BY action"""),
    "app_share": q("""counts AS (SELECT coalesce(app_name, 'unknown_app') AS app, count(*) AS n
                      FROM invoices WHERE action = 'boost' GROUP BY 1)""", select="""
        SELECT app, n, CAST(floor(CAST(100.0 AS DOUBLE) * (CAST(n AS DOUBLE) /
               CAST((SELECT sum(n) FROM counts) AS DOUBLE)) + 0.5) AS BIGINT) AS percent,
               row_number() OVER (ORDER BY n DESC, app) AS rank
        FROM counts"""),
    "first_streamer_per_episode": q("""ranked AS (
        SELECT episode, sender_name, created_epoch, app_name, value_sat_total, source,
               identifier, row_number() OVER (PARTITION BY episode
                                             ORDER BY creation_date, source, identifier) AS rn
        FROM invoices WHERE action = 'stream' AND episode IS NOT NULL)""", select="""
        SELECT episode, sender_name, created_epoch, app_name, value_sat_total, source, identifier
        FROM ranked WHERE rn = 1"""),
    "high_water_mark": q("""names AS (SELECT * FROM (VALUES ('wallet'), ('node_a'), ('node_b'), ('node_c')) t(source))""",
                         select=f"""
        SELECT names.source, coalesce(max(creation_date), {K.AUTOSCRAPE_START}) AS hwm
        FROM names LEFT JOIN invoices ON invoices.source = names.source GROUP BY names.source"""),
    "missing_content_ids": q(*SPLIT, select="SELECT content_id FROM missing"),
    "reconcile_rows": q(*SPLIT, select="""
        SELECT source, identifier, content_id, creation_date FROM src
        WHERE content_id IN (SELECT content_id FROM missing)"""),
    "reconcile_counts": q(*SPLIT, select="""
        SELECT (SELECT count(*) FROM dest_ids) AS destination_ids,
               (SELECT count(*) FROM src_ids) AS source_ids,
               (SELECT count(*) FROM missing) AS unique_to_source"""),
    "reconcile_merged": q(*SPLIT, select="""
        SELECT source, identifier, content_id, creation_date, message FROM dest
        UNION ALL
        SELECT source, identifier, content_id, creation_date, message FROM src
        WHERE content_id IN (SELECT content_id FROM missing)
          AND NOT EXISTS (SELECT 1 FROM dest d WHERE d.source = src.source
                                                 AND d.identifier = src.identifier)"""),
    "similar_payments": q("""s AS (SELECT action, sender_name_normalized AS sender, source, identifier,
                                        creation_date FROM invoices
                                 WHERE action IS NOT NULL AND sender_name_normalized IS NOT NULL)""",
                          select=f"""
        SELECT a.action, a.sender, a.source, a.identifier, a.creation_date, count(*) AS neighbours,
               min(abs(a.creation_date - b.creation_date)) AS nearest
        FROM s a JOIN s b ON a.action = b.action AND a.sender = b.sender
         AND abs(a.creation_date - b.creation_date) <= {P.SIMILAR_DELTA}
         AND (a.source <> b.source OR a.identifier <> b.identifier)
        GROUP BY 1, 2, 3, 4, 5"""),
    "upsert_merge": q(PATCHED, select="""
        SELECT i.source, i.identifier, coalesce(p.app_name, i.app_name) AS app_name,
               coalesce(p.message, i.message) AS message,
               coalesce(p.value_msat_total, i.value_msat_total) AS value_msat_total,
               coalesce(p.content_id, i.content_id) AS content_id
        FROM invoices i LEFT JOIN patched p ON i.source = p.source AND i.identifier = p.identifier"""),
    "delete_by_id": q(select=f"""SELECT source, identifier, creation_date FROM invoices
                                WHERE event_id % {P.DELETE_EVERY} <> 0"""),
    "since_identifier_boosts": q(LEGACY_BASE, select=f"""
        SELECT {LEGACY_COLS}, value_msat_total, creation_date FROM legacy"""),
    "since_identifier_ballers": q(LEGACY_BASE, select=f"""SELECT * FROM (
        SELECT {LEGACY_COLS.replace('value_sat_total', f'value_sat_total * {P.BALLER_SCALE} AS value_sat_total')} FROM legacy)
        WHERE value_sat_total >= 20000"""),
    "since_identifier_normal": q(LEGACY_BASE, select=f"""SELECT {LEGACY_COLS} FROM legacy
        WHERE value_sat_total >= 2000 AND value_sat_total < 20000"""),
    "since_identifier_thanks": q(LEGACY_BASE, select=f"SELECT {LEGACY_COLS} FROM legacy WHERE value_sat_total < 2000"),
    "since_identifier_by_show": q(select=f"""
        SELECT {LEGACY_COLS}, value_msat_total, creation_date FROM invoices
        WHERE action = 'boost' AND creation_date > {LAST_SEEN} AND {show_pred(SHOWS['Alpha'])}"""),
    "since_identifier_summary": q(LEGACY_BASE, select="""
        SELECT CAST(sum(value_sat_total) AS BIGINT) AS total_sats, count(*) AS boosts,
               count(DISTINCT sender_name_normalized) AS senders
        FROM legacy WHERE value_sat_total IS NOT NULL AND sender_name_normalized IS NOT NULL"""),
    "since_identifier_stream_summary": q(STREAM_WIN, select="""
        SELECT CAST(sum(value_sat_total) AS BIGINT) AS total_sats, count(*) AS streams,
               count(DISTINCT sender_name_normalized) AS streamers FROM sw"""),
    "since_identifier_stream_senders": q(STREAM_WIN, select="SELECT DISTINCT sender_name_normalized AS sender FROM sw"),
    "earliest_boost": q(select="""
        SELECT source, identifier, creation_date, created_epoch FROM invoices
        WHERE creation_date = (SELECT min(creation_date) FROM invoices WHERE action = 'boost')"""),
    "store_stats": q(select="SELECT count(*) AS invoices, max(creation_date) AS max_creation_date FROM invoices"),
    "decode_payload": q(select="""
        SELECT source, identifier, creation_date, creation_date AS created_epoch,
               CASE WHEN source = 'wallet' THEN NULL ELSE event_id END AS add_index,
               CASE WHEN source = 'wallet' THEN 'memo ' || identifier END AS memo,
               action, podcast, episode, app_name, sender_name, sender_name_normalized, message,
               value_msat_total, value_sat_total, content_id,
               CASE WHEN source = 'wallet' THEN NULL ELSE 'invoice/state' END AS extra_keys
        FROM invoices"""),
    "decode_quarantine": q(select=f"""
        SELECT source, identifier, 'boost_base64' AS reason FROM invoices
        WHERE source <> 'wallet' AND event_id % {P.CORRUPT_EVERY} = 0"""),
}

NL = "chr(10)"


def d_utc(cd: str) -> str:
    return f"make_timestamp(CAST({cd} AS BIGINT) * 1000000)"


def d_date(cd: str) -> str:
    local = f"timezone('America/Los_Angeles', timezone('UTC', {d_utc(cd)}))"
    return (f"(strftime({local}, '%Y/%m/%d %-I:%M:%S %p') || ' ' || "
            f"CASE date_diff('hour', {local}, {d_utc(cd)}) WHEN 7 THEN 'PDT' WHEN 8 THEN 'PST' END)")


def d_comma(x: str) -> str:
    return f"format('{{:,}}', CAST(coalesce({x}, 0) AS BIGINT))"


def d_quote(m: str, prefix: str = "> ") -> str:
    stripped = f"regexp_replace({m}, '(\\r?\\n)+$', '')"
    lines = (f"CASE WHEN {stripped} = '' AND {m} <> '' THEN CAST([] AS VARCHAR[]) "
             f"ELSE string_split_regex({stripped}, '\\r?\\n') END")
    return f"array_to_string(list_transform({lines}, lambda x: '{prefix}' || x), {NL})"


def d_s(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


_MSG_Q = d_quote("coalesce(message, 'No Message Found :(')")
_FLAT_Q = d_quote("coalesce(message, '')", "   > ")
_WHEN = (f"'+ ' || {d_date('creation_date')} || ' (' || CAST(creation_date AS VARCHAR) || ')' || {NL} "
         f"|| '+ ' || {d_comma('value_sat_total')} || ' sats' || {NL} "
         f"|| {_MSG_Q}")
_HEAD = (f"'+ ' || {d_s('podcast')} || {NL} || '+ ' || {d_s('episode')} || {NL} || '+ ' || "
         f"{d_s('app_name')} || {NL} || '+ ' || {d_s('source')} || {NL} || {NL}")
_NULLS = "CAST(NULL AS BIGINT) AS k1, CAST(NULL AS VARCHAR) AS k2"
_TNULLS = "CAST(NULL AS BIGINT) AS t1, CAST(NULL AS VARCHAR) AS t2, CAST(NULL AS VARCHAR) AS t3"

MARKDOWN_SELECT = f"""
SELECT 1 AS section, 0 AS part, {_NULLS}, 0 AS kind, {_TNULLS}, '## Baller Boosts' AS line
UNION ALL SELECT 2, 0, NULL, NULL, 0, NULL, NULL, NULL, '## Boosts'
UNION ALL SELECT 3, 0, NULL, NULL, 0, NULL, NULL, NULL, '## Thanks'
UNION ALL SELECT section, 1, k1, sender, 0, NULL, NULL, NULL,
  '### From: ' || sender || {NL} || '+ ' || {d_comma('total_sats')} || ' sats' || {NL}
  || '+ ' || {d_comma('boost_count')} || ' boosts' FROM snd
UNION ALL SELECT snd.section, 1, snd.k1, snd.sender, 1, det.created_epoch, det.source, det.identifier,
  CASE WHEN det.is_first THEN {_HEAD} || {_WHEN} ELSE {NL} || {_WHEN} END
  FROM det JOIN snd ON det.sender = snd.sender
UNION ALL SELECT section, 1, k1, sender, 2, NULL, NULL, NULL, '' FROM snd
UNION ALL SELECT section, 2, NULL, NULL, 0, NULL, NULL, NULL, ''
  FROM (VALUES (1), (2), (3)) sec(section) WHERE section NOT IN (SELECT section FROM snd)
UNION ALL SELECT 4, 0, NULL, NULL, 0, NULL, NULL, NULL,
  '## Boost Summary' || {NL} || '+ Total Boosted Sats: ' || {d_comma('boost_total_sats')}
  || {NL} || '+ Total Boosts: ' || {d_comma('boost_total_boosts')}
  || {NL} || '+ Total Boosters: ' || {d_comma('boost_total_boosters')}
  || {NL} || {NL} || '## Stream Summary' || {NL} || '+ Total Streamed Sats: ' || {d_comma('stream_total_sats')}
  || {NL} || '+ Total Streams: ' || {d_comma('stream_total_streams')}
  || {NL} || '+ Total Streamers: ' || {d_comma('stream_total_streamers')}
  || {NL} || {NL} || '## Summary' || {NL} || '+ Total Sats: ' || {d_comma('total_sats')}
  || {NL} || '+ Total Invoices: ' || {d_comma('total_invoices')}
  || {NL} || '+ Total Unique Senders: ' || {d_comma('total_unique_senders')}
  || {NL} || {NL} || '## Last Seen' || {NL} || '+ Last seen ID: ' || {d_s('last_seen_id')}
  FROM summ"""

MARKDOWN_CTES = window_ctes(SHOWS["Alpha"], P.SINCE_B) + [
    f"sndr AS ({SENDERS_SELECT.strip()})",
    """snd AS (SELECT *, CASE tier WHEN 'baller' THEN 1 WHEN 'boost' THEN 2 ELSE 3 END AS section,
                  CASE WHEN tier = 'baller' THEN -total_sats ELSE first_boost END AS k1 FROM sndr)""",
    """det AS (SELECT sender_name_normalized AS sender, creation_date, created_epoch, source, identifier, value_sat_total,
                  podcast, episode, app_name, message,
                  row_number() OVER (PARTITION BY sender_name_normalized
                                     ORDER BY created_epoch, source, identifier) = 1 AS is_first
           FROM counted WHERE action = 'boost')""",
    f"summ AS ({SUMMARY_SELECT.strip()})",
]

SQL["report_markdown_lines"] = q(*MARKDOWN_CTES, select=MARKDOWN_SELECT)

_BLOCK = (f"'### From: ' || {d_s('sender_name_normalized')} || {NL} || ' + ' || {d_comma('value_sat_total')} "
          f"|| ' sats' || {NL} || ' + ' || {d_s('podcast')} || ' / ' || {d_s('episode')} || {NL} || ' + ' "
          f"|| {d_s('app_name')} || ' ' || strftime({d_utc('creation_date')}, '%a %b %d %H:%M:%S UTC %Y') "
          f"|| ' (' || CAST(creation_date AS VARCHAR) || ')' || {NL} || ' + ' || {d_s('source')} || {NL} "
          f"|| {_FLAT_Q} || {NL}")

SQL["boost_blocks"] = q(valid_cte(SHOWS["All"], P.SINCE_B), select=f"""
    SELECT creation_date, source, identifier, {_BLOCK} AS block FROM valid WHERE action = 'boost'""")


def _show_union(since: int) -> str:
    parts = [f"SELECT '{name}' AS show_name, * FROM invoices WHERE creation_date > {since} "
             f"AND NOT coalesce(sender_name_normalized IN ({EXCL}), false) AND {show_pred(p)}"
             for name, p in SHOWS.items()]
    return "tagged AS (" + " UNION ALL ".join(parts) + ")"


MULTI_CTES = [
    _show_union(P.SINCE_B),
    "cuts AS (SELECT show_name, max(creation_date) FILTER (WHERE action = 'boost') AS cutoff FROM tagged GROUP BY show_name)",
    """mcounted AS (SELECT tagged.* FROM tagged JOIN cuts ON tagged.show_name = cuts.show_name
         WHERE tagged.creation_date <= cuts.cutoff AND sender_name_normalized IS NOT NULL
           AND value_sat_total IS NOT NULL)""",
]

SQL["report_all_shows"] = q(*MULTI_CTES, select=f"""
    SELECT show_name, sender_name_normalized AS sender, CAST(sum(value_sat_total) AS BIGINT) AS total_sats,
           count(*) AS boost_count, min(creation_date) AS first_boost,
           {tier('sum(value_sat_total)')} AS tier
    FROM mcounted WHERE action = 'boost' GROUP BY show_name, sender_name_normalized""")

_SHOW_NAMES = ", ".join(f"('{n}')" for n in SHOWS)
SQL["report_all_shows_summary"] = q(*MULTI_CTES, f"names AS (SELECT * FROM (VALUES {_SHOW_NAMES}) t(show_name))",
    """agg AS (SELECT show_name,
        CAST(sum(value_sat_total) FILTER (WHERE action = 'boost') AS BIGINT) AS boost_total_sats,
        count(*) FILTER (WHERE action = 'boost') AS boost_total_boosts,
        count(DISTINCT sender_name_normalized) FILTER (WHERE action = 'boost') AS boost_total_boosters,
        CAST(sum(value_sat_total) FILTER (WHERE action = 'stream') AS BIGINT) AS stream_total_sats,
        count(*) FILTER (WHERE action = 'stream') AS stream_total_streams,
        count(DISTINCT sender_name_normalized) FILTER (WHERE action = 'stream') AS stream_total_streamers,
        CAST(sum(value_sat_total) AS BIGINT) AS total_sats, count(*) AS total_invoices,
        count(DISTINCT sender_name_normalized) AS total_unique_senders
      FROM mcounted GROUP BY show_name)""", select="""
    SELECT names.show_name,
      coalesce(boost_total_sats, 0) AS boost_total_sats, coalesce(boost_total_boosts, 0) AS boost_total_boosts,
      coalesce(boost_total_boosters, 0) AS boost_total_boosters,
      coalesce(stream_total_sats, 0) AS stream_total_sats, coalesce(stream_total_streams, 0) AS stream_total_streams,
      coalesce(stream_total_streamers, 0) AS stream_total_streamers,
      coalesce(total_sats, 0) AS total_sats, coalesce(total_invoices, 0) AS total_invoices,
      coalesce(total_unique_senders, 0) AS total_unique_senders, cuts.cutoff AS last_seen_id
    FROM names LEFT JOIN agg ON names.show_name = agg.show_name LEFT JOIN cuts ON names.show_name = cuts.show_name""")

_LINK = """'\\[(.+?)\\]\\((.+?)(?: "(.+?)")?\\)'"""
SQL["markdown_links"] = f"""
WITH t AS (SELECT page_id, url,
             regexp_replace(coalesce(html, ''), '<a href="([^"]*)">([^<]*)</a>', '[\\2](\\1)', 'g')
             AS text FROM pages),
x AS (SELECT page_id, url, regexp_extract_all(text, {_LINK}, 1) AS texts,
             regexp_extract_all(text, {_LINK}, 2) AS links FROM t),
y AS (SELECT page_id, url, texts, links, unnest(range(len(texts))) AS pos FROM x)
SELECT page_id, TRY_CAST(regexp_replace(url, '[^0-9]', '', 'g') AS BIGINT) AS episode, pos,
       texts[pos + 1] AS text, links[pos + 1] AS link
FROM y"""

SQL["stream_ingest"] = q(select="""
    SELECT source, identifier, creation_date, action, sender_name_normalized, value_sat_total, content_id,
           message FROM invoices""")

SQL["load_since_mark"] = q(f"""marks AS (
      SELECT n.source, coalesce(max(i.creation_date), {K.AUTOSCRAPE_START}) AS hwm
      FROM (VALUES ('wallet'), ('node_a'), ('node_b')) n(source)
      LEFT JOIN invoices i ON i.source = n.source AND i.creation_date < {P.SINCE_B}
      GROUP BY n.source)""", select="""
    SELECT i.source, i.identifier, i.creation_date FROM invoices i JOIN marks m ON i.source = m.source
    WHERE i.creation_date >= m.hwm""")

SQL["similar_to_payment"] = q(select=f"""
    SELECT source, identifier, creation_date, value_sat_total FROM invoices
    WHERE action = '{P.SIMILAR_ACTION}' AND sender_name_normalized = '{P.SIMILAR_SENDER}'
      AND creation_date BETWEEN {P.SIMILAR_AT - P.SIMILAR_WINDOW} AND {P.SIMILAR_AT + P.SIMILAR_WINDOW}""")

SQL["point_lookup"] = q(select=f"""
    SELECT source, identifier, creation_date, action, content_id FROM invoices
    WHERE identifier = '{P.LOOKUP_ID}'""")

SQL["legacy_v1_rows"] = q(LEGACY_BASE, select="""
    SELECT app_name, creation_date, created_epoch, episode, identifier, message, podcast,
           sender_name_normalized AS sender_name, source, value_msat_total, value_sat_total FROM legacy""")

SQL["markdown_listing"] = f"""
WITH t AS (SELECT url AS file_name,
             regexp_replace(coalesce(html, ''), '<a href="([^"]*)">([^<]*)</a>', '[\\2](\\1)', 'g')
             AS text, TRY_CAST(regexp_replace(url, '[^0-9]', '', 'g') AS BIGINT) AS episode FROM pages),
x AS (SELECT file_name, episode, regexp_extract_all(text, {_LINK}, 1) AS texts,
             regexp_extract_all(text, {_LINK}, 2) AS links FROM t),
y AS (SELECT file_name, episode, texts, links, unnest(range(len(texts))) AS pos FROM x)
SELECT file_name, episode, -1 AS pos, '## ' || ' ' || coalesce(CAST(episode AS VARCHAR), '') AS line FROM t
UNION ALL
SELECT file_name, episode, CAST(pos AS INTEGER), '+ [' || ' ' || texts[pos + 1] || ' ' || '](' || ' ' || links[pos + 1] || ' ' || ')'
FROM y
UNION ALL
SELECT file_name, episode, 2000000000, '' FROM t"""


_UNTIL = f"creation_date > {P.SINCE_A} AND creation_date < {P.AS_OF - K.HOLD_BACK_SECONDS}"
SQL["reconcile_cycle"] = q(f"""stored AS (SELECT source, identifier, creation_date, content_id FROM invoices UNION ALL
          SELECT CASE source WHEN 'node_a' THEN 'wallet' ELSE 'node_b' END, 'copy ' || identifier, creation_date, content_id
          FROM invoices WHERE source <> 'node_b' AND event_id % {P.SHARED_EVERY} = 0)""",
                           f"""own AS (SELECT * FROM stored WHERE source = 'node_b')""",
                           f"""first AS (SELECT * FROM stored WHERE source = 'node_a' AND content_id IN (
          SELECT content_id FROM stored WHERE source = 'node_a' AND {_UNTIL} EXCEPT
          SELECT content_id FROM own WHERE creation_date > {P.SINCE_A} AND creation_date < {P.AS_OF}))""",
                           f"""second AS (SELECT * FROM stored WHERE source = 'wallet' AND content_id IN (
          SELECT content_id FROM stored WHERE source = 'wallet' AND {_UNTIL} EXCEPT
          SELECT content_id FROM (SELECT * FROM own UNION ALL SELECT * FROM first)
          WHERE creation_date > {P.SINCE_A} AND creation_date < {P.AS_OF}))""",
                           select="SELECT * FROM own UNION ALL SELECT * FROM first UNION ALL SELECT * FROM second")

SQL["store_merge"] = q(select="""
    SELECT source, identifier, message,
      CASE WHEN event_id % 10 = 0 THEN 'patched' WHEN event_id % 4 = 0 THEN 'v2' ELSE app_name END AS app_name, cd AS creation_date,
      coalesce(strftime(make_timestamp(cd * 1000000), '%Y-%m-%d'), 'none') AS day
    FROM (SELECT *, CASE WHEN event_id % 9 = 0 AND event_id % 2 = 0 THEN creation_date
                         WHEN event_id % 20 = 0 THEN creation_date + 259200
                         WHEN event_id % 9 = 0 THEN NULL ELSE creation_date END AS cd FROM invoices)""")

SQL["delete_from_store"] = q(select=f"""
    SELECT source, identifier, creation_date, strftime(make_timestamp(creation_date * 1000000), '%Y-%m-%d') AS day
    FROM invoices WHERE event_id % {P.DELETE_EVERY} <> 0""")

SQL["flatten_open"] = q(select=f"""
    SELECT source, identifier, 'foo/{"/".join(f"k{i}" for i in range(1, P.NESTING + 1))}' AS name,
           translate(coalesce(message, 'none'), chr(10), ' ') AS value FROM invoices""")

_KNOWN = f"""marks AS (
      SELECT n.source, coalesce(max(i.creation_date), {K.AUTOSCRAPE_START}) AS hwm
      FROM (VALUES ('wallet'), ('node_a'), ('node_b')) n(source)
      LEFT JOIN invoices i ON i.source = n.source AND i.creation_date < {P.SINCE_B}
      GROUP BY n.source)"""
SQL["load_until_epoch"] = q(_KNOWN, f"""numbered AS (SELECT source, identifier, creation_date AS cd,
        (SELECT max(event_id // {P.PAGE_IDS}) FROM invoices) - event_id // {P.PAGE_IDS} AS page FROM invoices)""",
    f"""paged AS (SELECT source, identifier, page, CASE WHEN page % {P.TIMELESS_PAGES} <> 0 THEN cd END AS creation_date FROM numbered)""",
    """newest AS (SELECT p.source, p.page, max(p.creation_date) < any_value(m.hwm) AS old
        FROM paged p JOIN marks m ON p.source = m.source GROUP BY p.source, p.page)""",
    """reached AS (SELECT *, coalesce(bool_or(old) OVER (PARTITION BY source ORDER BY page), false) AS stopped FROM newest)""", select="""
    SELECT p.source, p.identifier, p.page, p.creation_date FROM paged p
    JOIN reached r ON p.source = r.source AND p.page = r.page WHERE NOT stopped""")

_DROPPED = f"CAST(identifier AS BIGINT) % {P.DELETE_EVERY} = 0"


def _copied(n: int, source: str, where: str, known: str) -> str:
    """Rows of a source whose ids a pass finds missing among ``known``."""
    return f"""pass{n}_{source} AS (SELECT * FROM rows_ WHERE source = '{source}' AND {where} AND content_id IN (
          SELECT content_id FROM rows_ WHERE source = '{source}' AND {where} AND {_UNTIL} EXCEPT
          SELECT content_id FROM ({known}) WHERE creation_date > {P.SINCE_A} AND creation_date < {P.AS_OF}))"""


_OWN = "SELECT * FROM rows_ WHERE source = 'node_b'"
_FIRST = f"{_OWN} UNION ALL SELECT * FROM pass1_node_a"
_KEPT = f"SELECT * FROM ({_FIRST} UNION ALL SELECT * FROM pass1_wallet) WHERE NOT {_DROPPED}"
SQL["delete_after_replay"] = q("rows_ AS (SELECT source, identifier, creation_date, content_id FROM invoices)",
    _copied(1, "node_a", "true", _OWN), _copied(1, "wallet", "true", _FIRST),
    _copied(2, "node_a", f"NOT {_DROPPED}", _KEPT), _copied(2, "wallet", f"NOT {_DROPPED}", f"{_KEPT} UNION ALL SELECT * FROM pass2_node_a"),
    select=f"{_KEPT} UNION SELECT * FROM pass2_node_a UNION SELECT * FROM pass2_wallet")


def _runs() -> str:
    ctes, out = [], []
    for i, show in enumerate(P.REPORT_SHOWS):
        since = f"(SELECT {P.SINCE_A})"
        for run, until in enumerate(P.REPORT_RUNS, 1):
            name = f"s{i}r{run}"
            ctes.append(f"""{name}v AS (SELECT * FROM invoices WHERE creation_date > {since} AND creation_date < {until}
              AND NOT coalesce(sender_name_normalized IN ({EXCL}), false) AND {show_pred(SHOWS[show])})""")
            ctes.append(f"{name}c AS (SELECT max(creation_date) AS cutoff FROM {name}v WHERE action = 'boost')")
            out.append(f"""SELECT '{show}' AS show_name, {run} AS run, CAST({since} AS BIGINT) AS since, c.cutoff, v.source, v.identifier,
              v.creation_date FROM {name}v v, {name}c c WHERE v.creation_date <= c.cutoff""")
            since = f"(SELECT coalesce(cutoff, {since}) FROM {name}c)"
    return q(*ctes, select=" UNION ALL ".join(out))


SQL["report_cursor"] = _runs()

SQL["ingest_progress"] = q(select="""
    SELECT min(creation_date) AS min_creation_date, max(creation_date) AS max_creation_date, count(*) AS rows
    FROM invoices WHERE source = 'wallet'""")

SQL["markdown_directory"] = f"""
WITH t AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<a href="([^"]*)">([^<]*)</a>', '[\\2](\\1)', 'g') AS text FROM pages),
f AS (SELECT 'Pages ' || CAST(page_id // {P.PAGES_PER_FILE} AS VARCHAR) || '.md' AS file_name,
             string_agg(text, chr(10) ORDER BY page_id) || chr(10) AS text FROM t GROUP BY 1)
SELECT file_name, row_number() OVER (ORDER BY file_name) AS rank, length(text) AS n_chars, sha256(text) AS sha256,
       len(regexp_extract_all(text, {_LINK}, 1)) AS links FROM f"""

SQL["relative_times"] = q(select=f"""
    SELECT source, identifier, {P.AS_OF} - created_epoch AS seconds,
           CASE WHEN action = 'boost' THEN creation_date // 30 END AS per_30
    FROM invoices WHERE creation_date >= {P.AS_OF - K.TWO_WEEKS_SECONDS}""")

_REQUEST = window_ctes(SHOWS["Alpha"], P.AS_OF - K.TWO_WEEKS_SECONDS) + MARKDOWN_CTES[len(window_ctes(SHOWS["Alpha"], P.SINCE_B)):]
SQL["report_request"] = q(*_REQUEST, select=MARKDOWN_SELECT)

SQL["boosts_in_order"] = f"""
SELECT *, row_number() OVER (ORDER BY creation_date, source, identifier) AS rank FROM ({SQL["boost_blocks"]}) blocks"""

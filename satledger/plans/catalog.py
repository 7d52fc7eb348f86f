"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per
operator, all reading the driver tables (through the adapter) in full."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import content_id, epoch_of, normalize_sender
from satledger.operators import apps, history, leaderboard, merge, reconcile, report
from satledger.plans import params as P
from satledger.sources.adapter import load_invoices
from satledger.schemas import INVOICE_COLUMNS

SHOWS = P.SHOWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _inv(spark, sf_dir):
    return load_invoices(spark, sf_dir)


def _flat(df: DataFrame) -> DataFrame:
    """Store columns without the timestamp and map (epoch instead)."""
    cols = [c for c in INVOICE_COLUMNS if c not in ("created_at", "extra")]
    return df.select(*cols, epoch_of("created_at").alias("created_epoch"))


# --- adapter and per-row functions ------------------------------------------

@register
def invoices_adapter(spark, sf_dir):
    return _flat(_inv(spark, sf_dir))


@register
def content_ids(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return inv.select("source", "identifier", content_id().alias("content_id"))


@register
def sender_normalized(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return inv.select("source", "identifier", "sender_name",
                      normalize_sender("sender_name").alias("sender_name_normalized"))


# --- show report ---------------------------------------------------------------

@register
def valid_invoices(spark, sf_dir):
    v = report.valid_invoices(_inv(spark, sf_dir), SHOWS["Alpha"], P.SINCE_B, P.EXCLUDED)
    return v.select("source", "identifier", "creation_date", "action", "sender_name_normalized")


@register
def report_rows(spark, sf_dir):
    return report.report_rows(_inv(spark, sf_dir), SHOWS["Alpha"], P.SINCE_A, P.EXCLUDED)


@register
def report_cutoff(spark, sf_dir):
    v = report.valid_invoices(_inv(spark, sf_dir), SHOWS["Alpha"], P.SINCE_A, P.EXCLUDED)
    return report.report_cutoff(v)


@register
def report_senders(spark, sf_dir):
    w = report.report_window(_inv(spark, sf_dir), SHOWS["All"], P.SINCE_A, P.EXCLUDED)
    return report.report_senders(w)


@register
def report_senders_unplugged(spark, sf_dir):
    w = report.report_window(_inv(spark, sf_dir), SHOWS["Alpha"], P.SINCE_B, P.EXCLUDED)
    return report.report_senders(w)


@register
def report_sender_details(spark, sf_dir):
    w = report.report_window(_inv(spark, sf_dir), SHOWS["Alpha"], P.SINCE_B, P.EXCLUDED)
    return report.sender_details(w)


@register
def report_summary(spark, sf_dir):
    return report.boost_report(_inv(spark, sf_dir), SHOWS["All"], P.SINCE_A, P.EXCLUDED)["summary"]


@register
def report_summary_unplugged(spark, sf_dir):
    return report.boost_report(_inv(spark, sf_dir), SHOWS["Alpha"], P.SINCE_B,
                               P.EXCLUDED)["summary"]


# --- leaderboards ----------------------------------------------------------------

def _board(spark, sf_dir, action):
    return leaderboard.leaderboard_base(_inv(spark, sf_dir), P.SHOW_PATTERN, action,
                                        show_literal=P.BOARD_LITERAL)


@register
def leaderboard_boost_by_amount(spark, sf_dir):
    return leaderboard.top(_board(spark, sf_dir, K.ACTION_BOOST), "amount", P.TOP_K)


@register
def leaderboard_boost_by_count(spark, sf_dir):
    return leaderboard.top(_board(spark, sf_dir, K.ACTION_BOOST), "n", P.TOP_K)


@register
def leaderboard_stream_by_amount(spark, sf_dir):
    return leaderboard.top(_board(spark, sf_dir, K.ACTION_STREAM), "amount", P.TOP_K)


@register
def leaderboard_stream_by_count(spark, sf_dir):
    return leaderboard.top(_board(spark, sf_dir, K.ACTION_STREAM), "n", P.TOP_K)


def _all_actions(spark, sf_dir):
    return leaderboard.leaderboard_base(_inv(spark, sf_dir), P.ALL_ACTIONS_PATTERN, None,
                                        since=K.ALL_ACTIONS_SINCE,
                                        show_literal=P.LEGACY_LITERAL)


@register
def leaderboard_all_actions(spark, sf_dir):
    return _all_actions(spark, sf_dir)


@register
def leaderboard_totals(spark, sf_dir):
    return leaderboard.totals(_all_actions(spark, sf_dir))


# --- app share, first streamer -------------------------------------------------

@register
def app_share(spark, sf_dir):
    return apps.app_share(_inv(spark, sf_dir))


@register
def first_streamer_per_episode(spark, sf_dir):
    return apps.first_streamer_per_episode(_inv(spark, sf_dir))


# --- incremental load, merge, reconcile -------------------------------------------

@register
def high_water_mark(spark, sf_dir):
    return merge.high_water_marks(_inv(spark, sf_dir), spark, K.SOURCES + ["node_c"])


def _shared(inv: DataFrame, source) -> DataFrame:
    """Payments that another source knows too: the same content under its own key."""
    return (inv.filter((F.col("source") != "node_b") & (F.col("identifier").cast("bigint") % P.SHARED_EVERY == 0))
            .withColumn("source", source).withColumn("identifier", F.concat(F.lit("copy "), "identifier")))


def _split(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    own = F.col("source") == "node_b"
    return inv.filter(own).unionByName(_shared(inv, F.lit("node_b"))), inv.filter(~own)


@register
def missing_content_ids(spark, sf_dir):
    dest, src = _split(spark, sf_dir)
    return reconcile.missing_content_ids(dest, src, P.SINCE_A, P.AS_OF)


@register
def reconcile_rows(spark, sf_dir):
    dest, src = _split(spark, sf_dir)
    return reconcile.rows_to_copy(dest, src, P.SINCE_A, P.AS_OF) \
        .select("source", "identifier", "content_id", "creation_date")


@register
def reconcile_counts(spark, sf_dir):
    dest, src = _split(spark, sf_dir)
    return reconcile.sync_counts(dest, src, P.SINCE_A, P.AS_OF)


@register
def reconcile_merged(spark, sf_dir):
    dest, src = _split(spark, sf_dir)
    return reconcile.reconcile(dest, src, P.SINCE_A, P.AS_OF) \
        .select("source", "identifier", "content_id", "creation_date", "message")


@register
def similar_payments(spark, sf_dir):
    return reconcile.similar_counts(_inv(spark, sf_dir), P.SIMILAR_DELTA)


def _patched(inv: DataFrame) -> DataFrame:
    """Second versions: message absent, app renamed, content id recomputed."""
    p = (inv.filter(F.col("identifier").cast("bigint") % P.PATCH_EVERY == 0)
         .withColumn("message", F.lit(None).cast("string"))
         .withColumn("app_name", F.lit("patched")))
    return p.withColumn("content_id", content_id())


@register
def upsert_merge(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    merged = merge.upsert(inv, _patched(inv).withColumn("seq", F.lit(1)), "seq")
    return merged.select("source", "identifier", "app_name", "message", "value_msat_total",
                         "content_id")


@register
def delete_by_id(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    keys = inv.filter(F.col("identifier").cast("bigint") % P.DELETE_EVERY == 0)
    return merge.delete_keys(inv, keys).select("source", "identifier", "creation_date")


# --- legacy queries relative to a last-seen invoice ----------------------------------

def _legacy_base(spark, sf_dir):
    return history.since_identifier(_inv(spark, sf_dir), P.LAST_SEEN_ID, P.SHOW_PATTERN, P.LAST_SEEN_SOURCE,
                                    show_literal=P.LEGACY_LITERAL)


@register
def since_identifier_boosts(spark, sf_dir):
    return history.all_boosts(_legacy_base(spark, sf_dir))


@register
def since_identifier_ballers(spark, sf_dir):
    large = _inv(spark, sf_dir).withColumn("value_sat_total", F.col("value_sat_total") * P.BALLER_SCALE)
    return history.ballers(history.since_identifier(large, P.LAST_SEEN_ID, P.SHOW_PATTERN, P.LAST_SEEN_SOURCE,
                                                    show_literal=P.LEGACY_LITERAL))


@register
def since_identifier_normal(spark, sf_dir):
    return history.normal_boosts(_legacy_base(spark, sf_dir))


@register
def since_identifier_thanks(spark, sf_dir):
    return history.thanks(_legacy_base(spark, sf_dir))


@register
def since_identifier_by_show(spark, sf_dir):
    return history.boosts_by_show(_inv(spark, sf_dir), P.LAST_SEEN_ID, SHOWS["Alpha"],
                                  P.LAST_SEEN_SOURCE)


@register
def since_identifier_summary(spark, sf_dir):
    return history.summary(_legacy_base(spark, sf_dir))


@register
def since_identifier_stream_summary(spark, sf_dir):
    return history.stream_summary(_inv(spark, sf_dir), P.LAST_SEEN_ID, SHOWS["Beta"],
                                  P.LAST_SEEN_SOURCE)


@register
def since_identifier_stream_senders(spark, sf_dir):
    return history.stream_senders(_inv(spark, sf_dir), P.LAST_SEEN_ID, SHOWS["Beta"],
                                  P.LAST_SEEN_SOURCE)


@register
def earliest_boost(spark, sf_dir):
    return history.earliest_boost(_inv(spark, sf_dir))


@register
def store_stats(spark, sf_dir):
    return history.store_stats(_inv(spark, sf_dir))


# --- ingest: adapter rows re-encoded as upstream pages, then normalised -------------

def _landed_raw(inv: DataFrame, corrupt_every: int | None = None) -> DataFrame:
    from satledger.operators.ingest import parse_node_pages, parse_wallet_pages
    from satledger.sources import landing

    node = parse_node_pages(landing.node_pages(inv, corrupt_every=corrupt_every))
    wallet = parse_wallet_pages(landing.wallet_pages(inv))
    return node.unionByName(wallet)


@register
def decode_payload(spark, sf_dir):
    from satledger.operators.ingest import normalize

    norm = normalize(_landed_raw(_inv(spark, sf_dir)))
    return norm.select(
        "source", "identifier", "creation_date", epoch_of("created_at").alias("created_epoch"),
        "add_index", "memo", "action", "podcast", "episode", "app_name", "sender_name",
        "sender_name_normalized", "message", "value_msat_total", "value_sat_total", "content_id",
        F.array_join(F.sort_array(F.map_keys("extra")), ",").alias("extra_keys"))


@register
def decode_quarantine(spark, sf_dir):
    from satledger.operators.ingest import quarantine

    q = quarantine(_landed_raw(_inv(spark, sf_dir), corrupt_every=P.CORRUPT_EVERY))
    return q.select("source", "identifier", "reason")


# --- rendering ------------------------------------------------------------------------

@register
def report_markdown_lines(spark, sf_dir):
    from satledger.plans import render

    return render.report_lines(_inv(spark, sf_dir), SHOWS["Alpha"], P.SINCE_B, P.EXCLUDED)


@register
def boost_blocks(spark, sf_dir):
    from satledger.plans import render

    rows = report.valid_invoices(_inv(spark, sf_dir), SHOWS["All"], P.SINCE_B, P.EXCLUDED) \
        .filter(F.col("action") == K.ACTION_BOOST)
    return render.boost_blocks(rows)


# --- every show in one job ---------------------------------------------------------------

@register
def report_all_shows(spark, sf_dir):
    from satledger.plans import multishow

    return multishow.all_show_senders(_inv(spark, sf_dir), SHOWS, P.SINCE_B, P.EXCLUDED)


@register
def report_all_shows_summary(spark, sf_dir):
    from satledger.plans import multishow

    return multishow.all_show_summaries(_inv(spark, sf_dir), SHOWS, P.SINCE_B, P.EXCLUDED)


# --- Markdown links ------------------------------------------------------------------------

def _page_docs(spark, sf_dir):
    """The whole HTML of each page with its anchors turned into Markdown links."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    return pages.select("page_id", F.col("url").alias("file_name"), text.alias("text"))


@register
def markdown_links(spark, sf_dir):
    """M1 over every page text, with the episode number from the page URL."""
    from satledger.operators.links import episode_number, extract_links

    docs = _page_docs(spark, sf_dir)
    docs = docs.withColumn("episode", episode_number(F.col("file_name"))).drop("file_name")
    return extract_links(docs, "text")


# --- streaming ingest --------------------------------------------------------------------

@register
def stream_ingest(spark, sf_dir):
    """Adapter rows landed as node / wallet pages (JSON Lines, some node pages
    landed twice), ingested by the streaming job in several micro-batches."""
    from satledger.session import scratch_path
    from satledger.sources import landing
    from satledger.streaming.ingest import NODE, WALLET, Upstream, run_once

    inv = _inv(spark, sf_dir)
    base = scratch_path(spark, "landing")
    node = landing.node_pages(inv)
    node.select("source", "value").write.partitionBy("source").text(f"{base}/node")
    node.filter(F.col("page") % 4 == 0).select("source", "value") \
        .write.mode("append").partitionBy("source").text(f"{base}/node")
    landing.wallet_pages(inv).select("value").write.text(f"{base}/wallet")
    ups = [Upstream(s, f"{base}/node/source={s}", NODE, max_files_per_trigger=4)
           for s in landing.NODE_SOURCES]
    ups.append(Upstream("wallet", f"{base}/wallet", WALLET, max_files_per_trigger=4))
    store = run_once(spark, ups, f"{base}/store", f"{base}/checkpoint")
    return store.select("source", "identifier", "creation_date", "action", "sender_name_normalized",
                        "value_sat_total", "content_id", "message")


# --- smaller reference operators --------------------------------------------------------

@register
def load_since_mark(spark, sf_dir):
    """N1 + N2: marks of a store holding the first half of the data, applied
    to a landed batch holding everything."""
    inv = _inv(spark, sf_dir)
    store = inv.filter(F.col("creation_date") < P.SINCE_B)
    marks = merge.high_water_marks(store, spark, K.SOURCES)
    return merge.load_since_mark(inv, marks).select("source", "identifier", "creation_date")


@register
def similar_to_payment(spark, sf_dir):
    return reconcile.find_similar(_inv(spark, sf_dir), P.SIMILAR_ACTION, P.SIMILAR_SENDER,
                                  P.SIMILAR_AT, P.SIMILAR_WINDOW) \
        .select("source", "identifier", "creation_date", "value_sat_total")


@register
def point_lookup(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return history.lookup(inv, identifier=P.LOOKUP_ID).select("source", "identifier", "creation_date",
                                                               "action", "content_id")


@register
def legacy_v1_rows(spark, sf_dir):
    """F12 + F13: the last-seen boosts in the old flat layout, columns sorted."""
    rows = history.all_boosts(_legacy_base(spark, sf_dir))
    return history.alphabetical(history.strip_namespaces(rows))


@register
def markdown_listing(spark, sf_dir):
    """M2: the per-file listing (heading, links, blank line) over the same
    page texts as ``markdown_links``, keyed by page URL."""
    from satledger.operators.links import listing_lines

    return listing_lines(_page_docs(spark, sf_dir).drop("page_id"))


@register
def reconcile_cycle(spark, sf_dir):
    """N11 + N14 on the partitioned store: node_b is the reporting
    destination; node_a and wallet rows missing there are copied in."""
    from satledger.session import scratch_path
    from satledger.sources.store import write_store
    from satledger.streaming.cycle import sync_reporting

    base = scratch_path(spark, "cycle")
    inv = _inv(spark, sf_dir)
    shared = _shared(inv, F.when(F.col("source") == "node_a", "wallet").otherwise("node_b"))
    write_store(inv.unionByName(shared), f"{base}/store")
    rep = sync_reporting(spark, f"{base}/store", f"{base}/copies", "node_b", ["node_a", "wallet"],
                         as_of=P.AS_OF, since=P.SINCE_A)
    return rep.select("source", "identifier", "creation_date", "content_id")


def _version(inv: DataFrame, seq: int, **values) -> DataFrame:
    """A version of each row that carries its key and ``values`` only."""
    types = dict(inv.dtypes)
    cols = [F.col(c) if c in ("source", "identifier") else values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in INVOICE_COLUMNS]
    return inv.select(*cols, F.lit(seq).alias("seq"))


@register
def store_merge(spark, sf_dir):
    """N6 + S5 on the store: three batches with missing and moved event times and
    several versions of a key in one batch."""
    from satledger.session import scratch_path
    from satledger.sources.store import read_store
    from satledger.streaming.ingest import merge_into_store

    inv, path = _inv(spark, sf_dir), scratch_path(spark, "store-merge")
    eid, cd = F.col("identifier").cast("bigint"), F.col("creation_date")
    first = inv.withColumn("creation_date", F.when(eid % 9 != 0, cd)).withColumn("seq", F.lit(1))
    merge_into_store(_version(inv.filter(eid % 4 == 0), 2, app_name=F.lit("v2")).unionByName(first), path, "seq")
    moved = _version(inv.filter(eid % 10 == 0), 3, app_name=F.lit("patched"), creation_date=F.when(eid % 20 == 0, cd + 3 * 86400))
    merge_into_store(moved, path, "seq")
    merge_into_store(_version(inv.filter((eid % 9 == 0) & (eid % 2 == 0)), 4, creation_date=cd), path, "seq")
    return read_store(spark, path).select("source", "identifier", "app_name", "message", "creation_date", "day")


@register
def delete_from_store(spark, sf_dir):
    """N13 on the store: only the partitions that hold the keys are rewritten."""
    from satledger.session import scratch_path
    from satledger.sources.store import delete_rows, read_store, write_store

    inv, path = _inv(spark, sf_dir), scratch_path(spark, "store-delete")
    write_store(inv, path)
    delete_rows(inv.filter(F.col("identifier").cast("bigint") % P.DELETE_EVERY == 0), path)
    return read_store(spark, path).select("source", "identifier", "creation_date", "day")


@register
def flatten_open(spark, sf_dir):
    """I2 + I3: unknown keys nested ``P.NESTING`` levels deep, one row per flattened key."""
    from satledger.operators.ingest import normalize, open_keys

    inner = F.concat(F.lit('"'), "message", F.lit('"'))
    for level in range(P.NESTING, 0, -1):
        inner = F.concat(F.lit(f'{{"k{level}":'), inner, F.lit("}"))
    raw = F.concat(F.lit('{"add_index":"'), "identifier", F.lit('","foo":'), inner, F.lit("}"))
    rows = _inv(spark, sf_dir).withColumn("message", F.translate(F.coalesce("message", F.lit("none")), "\n", " "))
    norm = normalize(rows.select("source", raw.alias("raw")))
    return open_keys(norm, "source", "identifier")


def _paged(spark, sf_dir):
    """Invoices on pages of ``P.PAGE_IDS`` ids, page 0 with the highest ids; every
    ``P.TIMELESS_PAGES``th page has no event times."""
    inv = _inv(spark, sf_dir)
    block = F.floor(F.col("identifier").cast("bigint") / P.PAGE_IDS)
    page = inv.agg(F.max(block)).scalar() - block
    return inv.select("source", "identifier", page.alias("page"),
                      F.when(page % P.TIMELESS_PAGES != 0, F.col("creation_date")).alias("creation_date"))


@register
def load_until_epoch(spark, sf_dir):
    """N2 + N4: whole pages, newest first, up to the first one before the marks of a store
    that holds the first half of the data."""
    known = _inv(spark, sf_dir).filter(F.col("creation_date") < P.SINCE_B)
    marks = merge.high_water_marks(known, spark, K.SOURCES)
    return merge.load_until_epoch(_paged(spark, sf_dir), marks)


@register
def delete_after_replay(spark, sf_dir):
    """Rows are retracted, then all pages are loaded and reconciled again."""
    from satledger.session import scratch_path
    from satledger.sources.store import write_store
    from satledger.streaming import cycle
    from satledger.streaming.ingest import merge_into_store

    base, inv = scratch_path(spark, "retract"), _inv(spark, sf_dir)
    go = lambda: cycle.sync_reporting(spark, f"{base}/store", f"{base}/copies", "node_b", ["node_a", "wallet"],
                                      as_of=P.AS_OF, since=P.SINCE_A)
    write_store(inv, f"{base}/store")
    go()
    cycle.retract(spark, inv.filter(F.col("identifier").cast("bigint") % P.DELETE_EVERY == 0), f"{base}/store", f"{base}/copies")
    merge_into_store(inv, f"{base}/store")
    return go().select("source", "identifier", "creation_date", "content_id")


@register
def report_cursor(spark, sf_dir):
    """A8 + F1 + H9: three runs over growing data; each payment with the run that reports it."""
    from satledger.plans.cursor import next_report
    from satledger.session import scratch_path

    base, inv, out = scratch_path(spark, "cursor"), _inv(spark, sf_dir), []
    for run, until in enumerate(P.REPORT_RUNS, 1):
        for show in P.REPORT_SHOWS:
            pattern = SHOWS[show]
            done = next_report(inv.filter(F.col("creation_date") < until), show, pattern, f"{base}/cursors", f"{base}/reports", P.SINCE_A, P.EXCLUDED,
                               lambda rows, since, path, p=pattern: report.valid_invoices(rows, p, since, P.EXCLUDED)
                               .select("source", "identifier", "creation_date").write.mode("overwrite").parquet(path))
            if done:
                out.append(spark.read.schema("source string, identifier string, creation_date bigint").parquet(done["path"]).select(
                    F.lit(show).alias("show_name"), F.lit(run).alias("run"), F.lit(done["since"]).cast("bigint").alias("since"),
                    F.lit(done["cutoff"]).cast("bigint").alias("cutoff"), "*"))
    empty = spark.createDataFrame([], "show_name string, run int, since bigint, cutoff bigint, source string, identifier string, creation_date bigint")
    return functools.reduce(DataFrame.unionByName, out, empty)


@register
def ingest_progress(spark, sf_dir):
    """What the batches of the wallet's stream observed, as kept beside the store."""
    from satledger.session import scratch_path
    from satledger.sources import landing
    from satledger.streaming.ingest import WALLET, Upstream, read_progress, run_once

    base = scratch_path(spark, "progress")
    landing.wallet_pages(_inv(spark, sf_dir)).select("value").write.text(f"{base}/wallet")
    run_once(spark, [Upstream("wallet", f"{base}/wallet", WALLET, max_files_per_trigger=4)], f"{base}/store", f"{base}/checkpoint")
    return read_progress(spark, f"{base}/store").agg(
        F.min("min_creation_date").alias("min_creation_date"), F.max("max_creation_date").alias("max_creation_date"), F.sum("rows").alias("rows"))


@register
def markdown_directory(spark, sf_dir):
    """The page texts landed as ``.md`` files (``P.PAGES_PER_FILE`` pages each), read
    back whole with their place in name order."""
    from satledger.operators.links import extract_links
    from satledger.session import scratch_path
    from satledger.sources.markdown import ranked_markdown_dir, write_markdown_dir

    docs = _page_docs(spark, sf_dir)
    group = F.floor(F.col("page_id") / P.PAGES_PER_FILE)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("page_id", "text"))), lambda p: p["text"])
    files = docs.groupBy(F.concat(F.lit("Pages "), group.cast("string"), F.lit(".md")).alias("file_name")).agg(F.array_join(texts, "\n").alias("text"))
    path = scratch_path(spark, "markdown")
    write_markdown_dir(files, path)
    found = ranked_markdown_dir(spark, path)
    links = extract_links(found, "text").groupBy("file_name").agg(F.count(F.lit(1)).alias("links"))
    return found.join(links, "file_name", "left").select("file_name", "rank", F.length("text").cast("bigint").alias("n_chars"),
                                                         F.sha2("text", 256).alias("sha256"), F.coalesce("links", F.lit(0)).alias("links"))


# --- scalar functions and request -----------------------------------------------------

@register
def relative_times(spark, sf_dir):
    """Rows of the two weeks before the newest time that is asked for, their
    distance to it and their bucket of thirty seconds."""
    from satledger.functions.columns import per_30, relative_bound, seconds_between

    bound = relative_bound(P.AS_OF, K.TWO_WEEKS_SECONDS)
    inv = _inv(spark, sf_dir).filter(F.col("creation_date") >= bound)
    return inv.select("source", "identifier", seconds_between(F.col("created_at"), F.timestamp_seconds(F.lit(P.AS_OF))).alias("seconds"),
                      per_30().alias("per_30"))


@register
def report_request(spark, sf_dir):
    """The report of a named show since two weeks before ``P.AS_OF``."""
    from satledger.plans import request

    return request.report_for_request(_inv(spark, sf_dir), "Alpha", None, P.AS_OF, SHOWS, P.EXCLUDED)


@register
def boosts_in_order(spark, sf_dir):
    """All boosts by event time, each with its place."""
    from satledger.operators.ranking import global_rank
    from satledger.plans import render

    rows = report.valid_invoices(_inv(spark, sf_dir), SHOWS["All"], P.SINCE_B, P.EXCLUDED).filter(F.col("action") == K.ACTION_BOOST)
    return global_rank(render.boost_blocks(rows), F.col("creation_date"), F.col("source"), F.col("identifier"))

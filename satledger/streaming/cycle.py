"""The polling cycle (N11, N14): every ``interval`` load what has landed, then
reconcile into the reporting set.

The reporting set is a view: the destination source's own store rows plus a
*copies* table holding every row copied from the other sources because its
content id was missing there (each copy keeps its own ``source``, so the key
stays unique).  A cycle looks only at the ids that changed since the last one, or were held
back then, and merges only the newly copied rows into the copies table.

Reconciling is a step of the cycle, not of an ingest batch: it also runs when
no page has landed, so a row that was held back arrives in time.  A cycle that
fails is logged and the next one tries again: both steps are idempotent.
"""
from __future__ import annotations

import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.operators.reconcile import rows_to_copy, rows_with_ids
from satledger.schemas import KEY
from satledger.session import cut_lineage, read_json, write_json
from satledger.sources.store import (_fs, changed_content_ids, delete_rows, manifest, packed, packed_content_days, read_store,
                                     retracted, rows_of_days, unpacked)
from satledger.streaming.ingest import Upstream, merge_into_store, run_once

log = logging.getLogger(__name__)


def reporting_view(spark: SparkSession, store_path: str, copies_path: str,
                   dest_source: str) -> DataFrame:
    """The destination's own rows plus the rows copied into it."""
    own = read_store(spark, store_path).filter(F.col("source") == dest_source)
    return own.unionByName(read_store(spark, copies_path))


def _state_folder(copies_path: str) -> str:
    return f"{copies_path}-cycle"


def _in_window(since: int, until: int):
    """Whether an entry of a content id has a row with ``since < creation_date < until``:
    exact for all of the id's entries unless both bounds lie in one day."""
    return F.coalesce((F.col("last") > since) & (F.col("first") < until), F.lit(False))


def sync_reporting(spark: SparkSession, store_path: str, copies_path: str, dest_source: str,
                   src_sources: list[str], as_of: int,
                   since: int = K.AUTOSCRAPE_START - K.RECONCILE_LOOKBACK,
                   hold_back: int = K.HOLD_BACK_SECONDS) -> DataFrame:
    """One reconcile pass over the sources in order; returns the reporting view.

    Whether an id is missing can change only if its index entries changed, here or in
    the copies, or if it was held back in the last pass: these ids are looked up in the
    content indexes, and of the sources only the days that hold missing ids are read.
    The first pass, and one with another lower bound or an earlier time, looks at all
    ids.  What the last pass had seen lies beside the copies and is written last, so
    that a pass that fails is done again.  Retracted keys are not copied."""
    if as_of - hold_back - since < 2 * 86400:
        return _sync_by_scan(spark, store_path, copies_path, dest_source, src_sources, as_of, since, hold_back)
    before = read_json(spark, f"{_state_folder(copies_path)}/state.json") or {}
    usable = before.get("since") == since and before.get("as_of", as_of) <= as_of and before.get("shape") == [dest_source, src_sources, hold_back]
    seen = before if usable else {}
    stop = as_of - hold_back
    stored = manifest(spark, store_path)
    ids = None  # all
    if seen:
        ids = changed_content_ids(spark, store_path, seen["store"]).unionByName(changed_content_ids(spark, copies_path, seen["copies"]))
        ids = ids.unionByName(spark.read.schema("content_id string").parquet(seen["pending"]))
        ids = cut_lineage(ids.withColumn("content_id", packed()).distinct())
    # a row per id, source and day; what the destination holds, own or copied, tells which are known
    found = packed_content_days(spark, store_path, ids).withColumn("copied", F.lit(False))
    copied = packed_content_days(spark, copies_path, ids).withColumn("copied", F.lit(True))
    there = F.col("copied") | F.col("source").eqNullSafe(F.lit(dest_source))
    mine = ~F.col("copied") & F.col("source").isin(src_sources)
    known = F.max(there & _in_window(since, as_of)).over(Window.partitionBy("content_id"))
    wanted = F.max(~F.col("copied") & _in_window(since, stop)).over(Window.partitionBy("content_id", "source"))
    found = found.unionByName(copied).withColumns({"known": known, "wanted": wanted}).filter(mine)
    found = found.select("content_id", "source", "day", (F.col("wanted") & ~F.col("known")).alias("missing"),
                         F.coalesce(F.col("last") >= stop, F.lit(False)).alias("held_back"))
    found = cut_lineage(found.filter("missing OR held_back"))
    first = manifest(spark, copies_path)["version"]
    for name in src_sources:
        missing = found.filter((F.col("source") == name) & F.col("missing"))
        if manifest(spark, copies_path)["version"] != first:  # what an earlier source has brought
            now = packed_content_days(spark, copies_path, missing.select("content_id").distinct())
            missing = missing.join(now.filter(_in_window(since, as_of)), "content_id", "left_anti")
        days = missing.select("day").distinct().collect()  # at most the days
        if days:
            # retracted keys are not in the store
            rows = rows_of_days(spark, store_path, [(name, r["day"]) for r in days])
            merge_into_store(rows_with_ids(rows, missing.select("content_id").distinct()), copies_path)
    pending = f"{_state_folder(copies_path)}/pending-{uuid.uuid4().hex[:12]}"
    found.filter("held_back").select("content_id").distinct().withColumn("content_id", unpacked()).write.parquet(pending)
    write_json(spark, f"{_state_folder(copies_path)}/state.json", {
        "since": since, "as_of": as_of, "shape": [dest_source, src_sources, hold_back], "pending": pending,
        "store": stored, "copies": manifest(spark, copies_path)})
    if before:
        fs, Path = _fs(spark, copies_path)
        fs.delete(Path(before["pending"]), True)
    return reporting_view(spark, store_path, copies_path, dest_source)


def _sync_by_scan(spark, store_path, copies_path, dest_source, src_sources, as_of, since, hold_back) -> DataFrame:
    """A pass over a window of hours, for which entries by day are too coarse."""
    store = read_store(spark, store_path)
    gone = retracted(spark, store_path)
    for name in src_sources:
        dest = reporting_view(spark, store_path, copies_path, dest_source)
        src = store.filter(F.col("source") == name)
        merge_into_store(rows_to_copy(dest, src, since, as_of, hold_back).join(gone, KEY, "left_anti"), copies_path)
    return reporting_view(spark, store_path, copies_path, dest_source)


def retract(spark: SparkSession, keys: DataFrame, store_path: str, copies_path: str) -> None:
    """Take ``keys`` (source, identifier) out of the store and the reporting set; loading
    their pages again, backfill and reconcile leave them out."""
    keys = cut_lineage(keys.select(*KEY).distinct())
    delete_rows(keys, store_path)
    delete_rows(keys, copies_path)


def run_cycles(spark: SparkSession, upstreams: list[Upstream], store_path: str, copies_path: str,
               dest_source: str, src_sources: list[str], interval: float = K.POLL_SECONDS,
               cycles: int | None = None, clock=time.time, wait=time.sleep, checkpoint: str | None = None) -> int:
    """Cycle after cycle (``cycles`` of them, or for ever); the number that failed.

    The reconcile window starts at the fixed start less one hour, whatever the
    size of the store."""
    failed = turn = 0
    while cycles is None or turn < cycles:
        if turn:
            wait(interval)
        turn += 1
        try:
            run_once(spark, upstreams, store_path, checkpoint)
            sync_reporting(spark, store_path, copies_path, dest_source, src_sources, as_of=int(clock()))
        except Exception:  # noqa: BLE001 - the next cycle tries again
            failed += 1
            log.exception("cycle %d failed", turn)
    return failed

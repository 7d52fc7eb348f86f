"""Incremental ingest as Structured Streaming.

``readStream`` over each upstream's landing folder -> page parsing ->
``foreachBatch``: ``normalize`` -> merge into the store, ``quarantine`` ->
``<store>-quarantine``.

* A batch first collapses the versions of each key in landing order (file time,
  file, place in the file), then merges them by key (``sources/store.py``).
* The stream's own checkpoint is the cursor (H3): a file is marked done only
  after its batch committed, and a re-run batch is an idempotent merge, so an
  interrupted run neither loses nor double-counts rows.  It lies beside the
  store, so that a later run goes on where the last one ended.
* ``trigger(availableNow=True)`` loads what has landed; ``backfill`` reads the
  landed pages of one source again from an event time on (N4).
"""
from __future__ import annotations

import logging
import uuid
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.operators.ingest import NEWEST, PAGE, normalize, page_progress, parse_node_pages, parse_wallet_pages, quarantine
from satledger.operators.merge import newest_versions
from satledger.schemas import INVOICE_COLUMNS
from satledger.session import cut_lineage, path_exists, write_json
from satledger.sources.store import merge_rows, read_store

log = logging.getLogger(__name__)

NODE = "node"
WALLET = "wallet"


@dataclass
class Upstream:
    """A landing folder of one upstream: ``layout`` is ``node`` or ``wallet``.

    ``one_page_per_line``: pages are JSON Lines (default); otherwise each file
    holds one (possibly pretty-printed) page."""
    source: str
    path: str
    layout: str
    one_page_per_line: bool = True
    max_files_per_trigger: int | None = None


SEQ = "_seq"


def read_upstream(spark: SparkSession, up: Upstream, streaming: bool = True) -> DataFrame:
    """Landed invoices and broken pages of an upstream as text, with their landing order."""
    reader = spark.readStream if streaming else spark.read
    if streaming and up.max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", up.max_files_per_trigger)
    # ``text()`` has its own ``wholetext`` argument, which overrides options.
    pages = reader.text(up.path, wholetext=not up.one_page_per_line).select(
        "value", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("_file"))
    rows = (parse_node_pages if up.layout == NODE else parse_wallet_pages)(pages)
    return rows.select(F.lit(up.source).alias("source"), "raw", PAGE, NEWEST, "_file", F.col("pos").cast("bigint").alias("pos"))


def in_landing_order(rows: DataFrame) -> DataFrame:
    """``seq``: file time, file, line of the file (lines of a split are read in order),
    place in the page.  A stream can't number lines, its batches can."""
    order = F.struct("_file", F.monotonically_increasing_id(), "pos")
    return rows.select("source", "raw", PAGE, order.alias(SEQ))


def quarantine_path(store_path: str) -> str:
    return f"{store_path}-quarantine"


def merge_into_store(rows: DataFrame, store_path: str, seq: str | None = None) -> dict:
    """Merge normalised rows into the store; the batch's progress metrics.

    ``seq``: the column that orders the versions of a key; without it ``rows``
    has one row per key."""
    newest = newest_versions(rows.select(*INVOICE_COLUMNS, seq), seq) if seq else rows
    newest, progress = page_progress(newest.select(*INVOICE_COLUMNS), f"progress-{uuid.uuid4().hex}")
    newest = cut_lineage(newest)
    stats = progress.get
    if stats["rows"]:
        merge_rows(newest, store_path)
        log.info("ingest batch %s", stats)
    return stats


def load_batch(batch: DataFrame, batch_id: int | str, store_path: str) -> dict:
    """One landed batch into the store and its failures into the quarantine; loading
    it again replaces the same quarantine folder."""
    target = f"{quarantine_path(store_path)}/batch={batch_id}"
    quarantine(batch.select("source", "raw", PAGE)).write.mode("overwrite").parquet(target)
    return merge_into_store(normalize(in_landing_order(batch), keep=(SEQ,)), store_path, SEQ)


def progress_path(store_path: str) -> str:
    return f"{store_path}-progress"


def read_progress(spark: SparkSession, store_path: str) -> DataFrame:
    """What each batch observed when it was written; a batch that was run again has one row."""
    schema = "batch_id bigint, min_creation_date bigint, max_creation_date bigint, rows bigint"
    if not path_exists(spark, progress_path(store_path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(progress_path(store_path))


def read_quarantine(spark: SparkSession, store_path: str) -> DataFrame:
    """``source, identifier, reason, raw`` of everything that could not be decoded."""
    schema = "source string, identifier string, reason string, raw string"
    if not path_exists(spark, quarantine_path(store_path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{quarantine_path(store_path)}/batch=*")


def start_ingest(spark: SparkSession, upstreams: list[Upstream], store_path: str,
                 checkpoint: str | None = None, available_now: bool = True,
                 interval: str = K.POLL_INTERVAL):
    """Start the ingest query over all upstreams; returns the StreamingQuery.
    ``query.batch_progress`` holds the last batches' metrics."""
    streams = [read_upstream(spark, up) for up in upstreams]
    src = streams[0]
    for s in streams[1:]:
        src = src.unionByName(s)
    progress: deque[dict] = deque(maxlen=100)

    def each(batch: DataFrame, batch_id: int) -> None:
        seen = {"batch_id": batch_id, **load_batch(batch, batch_id, store_path)}
        write_json(batch.sparkSession, f"{progress_path(store_path)}/{batch_id}.json", seen)
        progress.append(seen)

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or f"{store_path}-checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    query = w.start()
    query.batch_progress = progress
    return query


def run_once(spark: SparkSession, upstreams: list[Upstream], store_path: str,
             checkpoint: str | None = None) -> DataFrame:
    """Process everything landed since the last run and return the store."""
    q = start_ingest(spark, upstreams, store_path, checkpoint, available_now=True)
    q.awaitTermination()
    return read_store(spark, store_path)


def backfill(spark: SparkSession, up: Upstream, store_path: str, since: int | None = None) -> dict:
    """Load the landed pages of one source again whose newest event time is ``since``
    or later, and those without times: whole pages, as they were fetched.  The merge is
    idempotent."""
    rows = read_upstream(spark, up, streaming=False)
    if since is not None:
        rows = rows.filter(F.col(NEWEST).isNull() | (F.col(NEWEST) >= since))
    return merge_into_store(normalize(in_landing_order(rows), keep=(SEQ,)), store_path, SEQ)

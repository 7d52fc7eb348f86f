"""Streaming ingest (availableNow over several files and micro-batches)
equals one batch load of the same pages."""
import json

from pyspark.sql import functions as F

from helpers import boostagram, node_invoice
from satledger.operators.ingest import normalize, parse_node_pages, parse_wallet_pages
from satledger.operators.merge import upsert
from satledger.session import scratch_path
from satledger.streaming.ingest import NODE, WALLET, Upstream, run_once


def test_stream_equals_batch(spark):
    base = scratch_path(spark, "stream-test")
    node_pages = []
    for p in range(6):
        invs = [json.loads(node_invoice(str(i), str(1725148800 + 3600 * i),
                                        boostagram(action="boost", sender_name=f"s{i % 4}",
                                                   value_msat_total=1000 * i)))
                for i in range(p * 5, p * 5 + 6)]          # one invoice overlaps the next page
        node_pages.append(json.dumps({"first_index_offset": str(p), "invoices": invs}))
    wallet_pages = [json.dumps([{"identifier": f"w{i}", "creation_date": 1725148800 + i,
                                 "boostagram": {"action": "stream", "value_msat_total": 5000}}
                                for i in range(p * 3, p * 3 + 3)]) for p in range(3)]
    for i, page in enumerate(node_pages):
        spark.createDataFrame([(page,)], "value string").coalesce(1).write.text(f"{base}/node/{i}")
    for i, page in enumerate(wallet_pages):
        spark.createDataFrame([(page,)], "value string").coalesce(1).write.text(f"{base}/wallet/{i}")
    ups = [Upstream("node_a", f"{base}/node/*", NODE, max_files_per_trigger=2),
           Upstream("wallet", f"{base}/wallet/*", WALLET, max_files_per_trigger=1)]
    store = run_once(spark, ups, f"{base}/store", f"{base}/ckpt").drop("day")

    node = normalize(parse_node_pages(spark.read.text(f"{base}/node/*")), "node_a")
    wallet = normalize(parse_wallet_pages(spark.read.text(f"{base}/wallet/*")), "wallet")
    batch = node.unionByName(wallet)
    batch = upsert(batch.limit(0), batch.withColumn("seq", F.monotonically_increasing_id()), "seq").select(*store.columns)
    key = ["source", "identifier"]
    assert store.count() == batch.count() == 31 + 9
    cols = [c for c in store.columns if c != "extra"]
    assert store.select(cols).orderBy(key).collect() == batch.select(cols).orderBy(key).collect()
    assert store.filter(F.col("day").isNotNull() if "day" in store.columns else F.lit(True)).count() == 40


def test_sync_reporting_idempotent(spark):
    from helpers import boost, invoices
    from satledger.sources.store import write_store
    from satledger.streaming.cycle import sync_reporting

    base = scratch_path(spark, "cycle")
    inv = invoices(spark, [boost(1, 1000, "a", 5, source="node_b"),
                           boost(1, 1000, "a", 5, source="node_a"),     # same content
                           boost(2, 2000, "b", 6, source="node_a"),     # missing in node_b
                           boost(3, 2950, "c", 7, source="wallet"),     # held back at 3500
                           boost(4, 900, "d", 8, source="wallet", message="old")])
    write_store(inv, f"{base}/store")
    args = (spark, f"{base}/store", f"{base}/rep", "node_b", ["node_a", "wallet"])
    first = sync_reporting(*args, as_of=3500, since=0)
    assert sorted((r.source, r.identifier) for r in first.collect()) == [
        ("node_a", "2"), ("node_b", "1"), ("wallet", "4")]
    again = sync_reporting(*args, as_of=3500, since=0)
    assert again.count() == 3
    later = sync_reporting(*args, as_of=4000, since=0)
    assert later.count() == 4


def test_restart_resumes_from_checkpoint(spark):
    """The stream checkpoint is the cursor: a re-run ingests nothing twice,
    newly landed pages (with an updated version of an old invoice) arrive."""
    base = scratch_path(spark, "restart")

    def land(i, invs):
        page = json.dumps({"first_index_offset": str(i), "invoices": [json.loads(x) for x in invs]})
        spark.createDataFrame([(page,)], "value string").coalesce(1).write.text(f"{base}/node/{i}")

    land(0, [node_invoice(str(i), str(1725148800 + i), boostagram(action="boost", sender_name="a",
                                                                   value_msat_total=1000, message="v1"))
             for i in range(5)])
    ups = [Upstream("node_a", f"{base}/node/*", NODE)]
    first = run_once(spark, ups, f"{base}/store", f"{base}/ckpt")
    snap = sorted(map(tuple, first.drop("extra").collect()))
    again = run_once(spark, ups, f"{base}/store", f"{base}/ckpt")
    assert sorted(map(tuple, again.drop("extra").collect())) == snap
    land(1, [node_invoice("4", "1725148804", boostagram(action="boost", sender_name="a",
                                                        value_msat_total=1000)),
             node_invoice("9", "1725148809", boostagram(action="stream", value_msat_total=2000))])
    third = run_once(spark, ups, f"{base}/store", f"{base}/ckpt")
    got = {r.identifier: r.message for r in third.collect()}
    assert len(got) == 6 and got["4"] == "v1" and got["9"] is None


def test_cycle_without_missing_ids_writes_nothing(spark):
    import glob
    import os

    from helpers import boost, invoices
    from satledger.sources.store import write_store
    from satledger.streaming.cycle import sync_reporting

    base = scratch_path(spark, "cycle-noop")
    inv = invoices(spark, [boost(1, 1000, "a", 5, source="node_b"),
                           boost(2, 2000, "b", 6, source="node_a")])
    write_store(inv, f"{base}/store")
    args = (spark, f"{base}/store", f"{base}/copies", "node_b", ["node_a"])
    assert sync_reporting(*args, as_of=5000, since=0).count() == 2
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{base}/copies/**/*.parquet", recursive=True)}
    assert before
    assert sync_reporting(*args, as_of=5000, since=0).count() == 2
    after = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{base}/copies/**/*.parquet", recursive=True)}
    assert after == before


def _land(spark, base, name, invoices):
    page = json.dumps({"invoices": [json.loads(i) if isinstance(i, str) else i for i in invoices]})
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("append").text(f"{base}/{name}")


def test_cycles_reconcile_without_new_pages_and_survive_a_failure(spark, monkeypatch):
    import satledger.streaming.cycle as cycle

    base = scratch_path(spark, "cycles")
    at = 1725148800
    _land(spark, base, "node_b", [node_invoice("1", str(at), boostagram(action="boost", sender_name="a", value_msat_total=1000))])
    _land(spark, base, "node_a", [node_invoice("2", str(at + 5000), boostagram(action="boost", sender_name="b", value_msat_total=2000))])
    ups = [Upstream(n, f"{base}/{n}", NODE) for n in ("node_a", "node_b")]
    times = iter([at + 5100, at + 5100, at + 9000])  # held back until 600 s after the row
    seen, real = [], cycle.sync_reporting

    def sync(*args, **kw):
        if len(seen) == 1 and "failed" not in seen:
            seen.append("failed")
            raise RuntimeError("a cycle fails")
        out = real(*args, **kw)
        seen.append(sorted((r.source, r.identifier) for r in out.collect()))
        return out

    monkeypatch.setattr(cycle, "sync_reporting", sync)
    failed = cycle.run_cycles(spark, ups, f"{base}/store", f"{base}/copies", "node_b", ["node_a"], cycles=3,
                              clock=lambda: next(times), wait=lambda s: None)
    assert failed == 1 and seen == [[("node_b", "1")], "failed", [("node_a", "2"), ("node_b", "1")]]


def test_everything_landed_is_in_store_or_quarantine_and_a_rerun_loads_nothing(spark):
    from satledger.sources.store import manifest
    from satledger.streaming.ingest import backfill, read_quarantine

    base = scratch_path(spark, "landed")
    _land(spark, base, "node_a", [node_invoice("1", "100", "!!"), node_invoice("2", "200")])
    spark.createDataFrame([('{"invoices":[{"add_index":',)], "value string").coalesce(1).write.mode("append").text(f"{base}/node_a")
    up = Upstream("node_a", f"{base}/node_a", NODE)
    store = run_once(spark, [up], f"{base}/store")
    assert sorted(r.identifier for r in store.collect()) == ["1", "2"]
    bad = {(r.reason, r.identifier) for r in read_quarantine(spark, f"{base}/store").collect()}
    assert bad == {("page", None), ("boost_base64", "1")}
    version = manifest(spark, f"{base}/store")["version"]
    run_once(spark, [up], f"{base}/store")
    assert manifest(spark, f"{base}/store")["version"] == version
    # the page holds a payment from 150 on and counts whole; none is from 250 on
    assert backfill(spark, up, f"{base}/store", since=150)["rows"] == 2
    assert backfill(spark, up, f"{base}/store", since=250)["rows"] == 0
    assert store.count() == 2

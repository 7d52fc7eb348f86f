"""Reconcile passes that look at changed ids only, against passes over all rows."""
import random

from pyspark.sql import functions as F

import satledger.sources.store as store_module
from satledger.schemas import INVOICES
from satledger.session import scratch_path
from satledger.sources.store import delete_rows, read_store
from satledger.streaming import cycle
from satledger.streaming.ingest import merge_into_store

DAY = 86400


def payments(spark, rows):
    """Rows of (source, identifier, creation_date, content_id)."""
    df = spark.createDataFrame(rows, "source string, identifier string, creation_date bigint, content_id string")
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in INVOICES.fields])


def view(spark, base, copies):
    return sorted((r["source"], r["identifier"], r["creation_date"] or -1, r["content_id"] or "")
                  for r in cycle.reporting_view(spark, f"{base}/store", copies, "b").collect())


def test_delta_passes_equal_full_passes(spark):
    """New, changed, moved, held-back and retracted payments; ids that a third of all share."""
    rng, base = random.Random(5), scratch_path(spark, "deltas")
    one = lambda step: (rng.choice("abcc"), str(rng.randrange(25)), rng.choice([None, step * DAY + rng.randrange(DAY), rng.choice([0, 2, 9]) * DAY]),
                        rng.choice(["plain", *"stuvwxyz"]))
    for step in range(4, 7):
        rows = {(r[0], r[1]): r for r in (one(step) for _ in range(30))}
        merge_into_store(payments(spark, list(rows.values())), f"{base}/store")
        if step == 5:
            gone = spark.createDataFrame([("b", str(i)) for i in range(6)] + [("a", "3")], "source string, identifier string")
            cycle.retract(spark, gone, f"{base}/store", f"{base}/deltas")
            delete_rows(gone, f"{base}/scans")
        as_of = step * DAY + DAY // 2
        cycle.sync_reporting(spark, f"{base}/store", f"{base}/deltas", "b", ["a", "c"], as_of, since=DAY, hold_back=DAY // 4)
        cycle._sync_by_scan(spark, f"{base}/store", f"{base}/scans", "b", ["a", "c"], as_of, DAY, DAY // 4)
        assert view(spark, base, f"{base}/deltas") == view(spark, base, f"{base}/scans")
    assert len(view(spark, base, f"{base}/deltas")) > 20


def test_a_pass_reads_the_named_days_only(spark, monkeypatch):
    base = scratch_path(spark, "named")
    merge_into_store(payments(spark, [(s, f"{s}{d}", d * DAY + 10, f"{s if d % 2 else ''}{d}") for s in "ab" for d in range(1, 21)]), f"{base}/store")
    go = lambda as_of: cycle.sync_reporting(spark, f"{base}/store", f"{base}/copies", "b", ["a"], as_of, since=0, hold_back=100)
    assert go(21 * DAY).count() == 30
    merge_into_store(payments(spark, [("a", "new", 7 * DAY + 99, "new"), ("a", "again", 3 * DAY, "new"), ("a", "a5", 5 * DAY + 10, "4")]), f"{base}/store")
    read, data = store_module._read, []

    def noted(spark_, path, table, state, only=None, turn=False):
        if table == "data" and path.endswith("store"):
            data.append(list(state["data"]) if only is None else list(only))
        return read(spark_, path, table, state, only, turn)

    monkeypatch.setattr(store_module, "_read", noted)
    monkeypatch.setattr(cycle, "reporting_view", lambda *a: None)
    go(22 * DAY)
    assert [sorted(d) for d in data] == [["source=a/day=1970-01-04", "source=a/day=1970-01-08"]]
    data.clear()
    go(23 * DAY)  # nothing has changed
    assert data == []
    monkeypatch.undo()
    assert {r["identifier"] for r in cycle.reporting_view(spark, f"{base}/store", f"{base}/copies", "b").filter("source = 'a'").collect()} \
        == {f"a{d}" for d in range(1, 21, 2)} | {"new", "again"}


def test_a_failed_pass_is_done_again(spark, monkeypatch):
    base = scratch_path(spark, "failed")
    merge_into_store(payments(spark, [("a", "1", DAY, "x"), ("c", "1", DAY, "y")]), f"{base}/store")
    args = (spark, f"{base}/store", f"{base}/copies", "b", ["a", "c"], 9 * DAY, 0, 100)
    merge = cycle.merge_into_store
    calls = []

    def once(rows, path):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return merge(rows, path)

    monkeypatch.setattr(cycle, "merge_into_store", once)
    try:
        cycle.sync_reporting(*args)
        raise AssertionError("the second source should fail")
    except RuntimeError:
        pass
    assert cycle.sync_reporting(*args).count() == 2 and read_store(spark, f"{base}/copies").count() == 2

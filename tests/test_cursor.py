"""Reports one after the other: no gap, no repeat, also after a crash; places in a global order."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from satledger.operators.ranking import global_rank
from satledger.plans import params as P
from satledger.plans.cursor import cursor_file, next_report
from satledger.session import read_json, scratch_path, write_json
from satledger.sources.adapter import load_invoices


def test_consecutive_reports(spark):
    inv, base, seen = load_invoices(spark, SF0001), scratch_path(spark, "cursor"), []
    args = ("All", ".*", f"{base}/cursors", f"{base}/reports", P.SINCE_A, P.EXCLUDED)
    keep = lambda rows, since, path: seen.append((since, rows.filter(F.col("creation_date") > since).select("source", "identifier").collect()))

    def crash(rows, since, path):
        raise RuntimeError("lost")

    first = next_report(inv.filter(F.col("creation_date") < P.SINCE_B), *args, write=keep)
    with pytest.raises(RuntimeError):
        next_report(inv.filter(F.col("creation_date") < P.AS_OF - 9 * 86400), *args, write=crash)
    # more has come in meanwhile: the window that was begun is finished first
    second = next_report(inv, *args, write=keep)
    assert second["since"] == first["cutoff"] and second["cutoff"] < P.AS_OF - 9 * 86400
    third = next_report(inv, *args, write=keep)
    assert third["since"] == second["cutoff"] and next_report(inv, *args, write=keep) is None
    assert [s for s, _ in seen] == [P.SINCE_A, first["cutoff"], second["cutoff"]]
    rows = [r for _, part in seen for r in part]
    want = inv.filter((F.col("creation_date") > P.SINCE_A) & (F.col("creation_date") <= third["cutoff"])).select("source", "identifier").collect()
    assert sorted(rows) == sorted(want) and len(rows) == len(set(rows))


def test_a_report_is_written_per_show(spark):
    inv, base = load_invoices(spark, SF0001), scratch_path(spark, "cursor")
    done = [next_report(inv, show, P.SHOWS[show], f"{base}/cursors", f"{base}/reports", P.SINCE_B) for show in ("Alpha", "Beta")]
    assert len({d["path"] for d in done}) == 2
    assert all(spark.read.text(d["path"]).filter("value = '## Last Seen'").count() == 1 for d in done)
    assert read_json(spark, cursor_file(f"{base}/cursors", "Alpha")) == {"show": "Alpha", "cursor": done[0]["cutoff"], "open": None}


def test_json_files_are_replaced_or_kept(spark):
    path = f"{scratch_path(spark, 'json')}/state.json"
    assert read_json(spark, path) is None
    write_json(spark, path, {"a": "é"})
    write_json(spark, path, {"a": 2})
    with pytest.raises(Exception, match="exists"):
        write_json(spark, path, {"a": 3}, overwrite=False)
    assert read_json(spark, path) == {"a": 2}


def test_global_rank(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "hot", "hot", *"abc"]), rng.randrange(4)) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, k string, n int").repartition(6)
    ranked = global_rank(df, F.col("n").desc(), F.col("k").asc_nulls_first(), F.col("i"), partitions=5)
    assert ranked.columns == ["i", "k", "n", "rank"]
    want = sorted(rows, key=lambda r: (-r[2], r[1] is not None, r[1] or "", r[0]))
    assert [(r["i"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(w[0], j) for j, w in enumerate(want, 1)]
    assert global_rank(df.limit(0), F.col("i")).count() == 0

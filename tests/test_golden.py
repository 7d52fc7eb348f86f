"""Golden values from FIXTURES.md section 6 (exclusions user_5, user_8)."""
import pytest
from pyspark.sql import functions as F

from conftest import SF0001, SF001
from satledger.plans import params as P
from satledger.operators import apps, reconcile, report
from satledger.sources.adapter import load_invoices

A, B = 1704067200, 1705363200
EXCL = ["user_5", "user_8"]

GOLDEN = [
    (SF0001, "All", A, {"baller": (11, 434497), "boost": (1, 11518)},
     (446015, 137, 12), (776900, 262, 12), (1951437, 656, 12), 1706657176),
    (SF0001, "Alpha", B, {"boost": (10, 67749), "thanks": (1, 1015)},
     (68764, 16, 11), (75978, 28, 11), (237900, 72, 12), 1706637110),
    (SF001, "All", A, {"baller": (112, 3892232), "boost": (31, 466066)},
     (4358298, 1509, 143), (9160039, 3049, 143), (22755383, 7615, 143), 1706657097),
    (SF001, "Alpha", B, {"baller": (1, 27588), "boost": (72, 470797), "thanks": (34, 32249)},
     (530634, 195, 107), (1125910, 380, 134), (2706141, 936, 143), 1706655688),
]


@pytest.mark.parametrize("sf,show,since,tiers,boost,stream,total,cutoff", GOLDEN)
def test_report_golden(spark, sf, show, since, tiers, boost, stream, total, cutoff):
    rep = report.boost_report(load_invoices(spark, sf), P.SHOWS[show], since, EXCL)
    got = {r["tier"]: (r["n"], r["s"]) for r in
           rep["senders"].groupBy("tier").agg(F.count("*").alias("n"),
                                              F.sum("total_sats").alias("s")).collect()}
    assert got == tiers
    s = rep["summary"].first()
    assert (s.boost_total_sats, s.boost_total_boosts, s.boost_total_boosters) == boost
    assert (s.stream_total_sats, s.stream_total_streams, s.stream_total_streamers) == stream
    assert (s.total_sats, s.total_invoices, s.total_unique_senders) == total
    assert s.last_seen_id == cutoff


def test_app_share_golden(spark):
    got = {r.app: (r.n, r.percent) for r in apps.app_share(load_invoices(spark, SF001)).collect()}
    assert got == {"app_0": (326, 16), "app_1": (366, 18), "app_2": (356, 18),
                   "app_3": (342, 17), "app_4": (285, 14), "unknown_app": (306, 15)}


@pytest.mark.parametrize("sf,expected", [(SF0001, 333), (SF001, 3333)])
def test_reconcile_golden(spark, sf, expected):
    inv = load_invoices(spark, sf)
    eid = F.col("identifier").cast("bigint")
    dest, src = inv.filter(eid % 2 == 0), inv.filter(eid % 3 != 0)
    rows = reconcile.rows_to_copy(dest, src, A, 1706659200)
    assert rows.count() == expected
    assert rows.select("content_id").distinct().count() == expected

"""Hot keys: a third of the rows share one sender, a third are plain invoices
sharing the constant content id.  Results must equal DuckDB on the same rows."""
import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from satledger import constants as K
from satledger.functions.columns import content_id
from satledger.operators import reconcile, report
from satledger.sources.adapter import load_invoices


@pytest.fixture(scope="module")
def skewed(spark):
    inv = load_invoices(spark, SF001)
    eid = F.col("identifier").cast("bigint")
    hot_sender = eid % 3 == 1
    plain = eid % 3 == 2
    inv = (inv.withColumn("sender_name_normalized",
                          F.when(hot_sender, F.lit("hot")).otherwise(F.col("sender_name_normalized")))
           .withColumn("sender_name", F.when(hot_sender, F.lit("hot")).otherwise(F.col("sender_name"))))
    for c in ["action", "app_name", "podcast", "episode", "sender_name", "message"]:
        inv = inv.withColumn(c, F.when(plain, F.lit(None).cast("string")).otherwise(F.col(c)))
    inv = inv.withColumn("value_msat_total", F.when(plain, F.lit(None).cast("bigint"))
                         .otherwise(F.col("value_msat_total")))
    inv = inv.withColumn("value_sat_total", F.when(plain, F.lit(None).cast("bigint"))
                         .otherwise(F.col("value_sat_total")))
    inv = inv.withColumn("content_id", content_id()).drop("extra", "created_at").cache()
    con = duckdb.connect()
    con.register("inv", inv.toPandas())
    return inv, con


def test_hot_key_shape(skewed):
    inv, con = skewed
    assert con.execute(f"SELECT count(*) FROM inv WHERE content_id = '{K.PLAIN_CONTENT_ID}'").fetchone()[0] \
        == inv.filter(F.col("identifier").cast("bigint") % 3 == 2).count()


def test_report_with_hot_sender(skewed):
    inv, con = skewed
    rep = report.boost_report(inv.withColumn("created_at", F.timestamp_seconds("creation_date")),
                              ".*", 1704067200)
    got = {r.sender: (r.total_sats, r.boost_count) for r in rep["senders"].collect()}
    want = dict((s, (t, n)) for s, t, n in con.execute("""
        WITH cut AS (SELECT max(creation_date) c FROM inv WHERE creation_date > 1704067200
                     AND podcast IS NOT NULL AND action = 'boost')
        SELECT sender_name_normalized, sum(value_sat_total)::BIGINT, count(*) FROM inv, cut
        WHERE creation_date > 1704067200 AND creation_date <= cut.c AND podcast IS NOT NULL
          AND action = 'boost' AND sender_name_normalized IS NOT NULL AND value_sat_total IS NOT NULL
        GROUP BY 1""").fetchall())
    assert got == want and got["hot"][1] > 100


def test_similar_payments_with_hot_sender(skewed):
    inv, con = skewed
    got = reconcile.similar_counts(inv, 600).agg(F.sum("neighbours")).first()[0] // 2  # each pair from both ends
    want = con.execute("""
        WITH s AS (SELECT * FROM inv WHERE action IS NOT NULL AND sender_name_normalized IS NOT NULL)
        SELECT count(*) FROM s a JOIN s b ON a.action = b.action
          AND a.sender_name_normalized = b.sender_name_normalized
          AND abs(a.creation_date - b.creation_date) <= 600
          AND (a.source < b.source OR (a.source = b.source AND a.identifier < b.identifier))""").fetchone()[0]
    assert got == want and want > 0


def test_reconcile_with_hot_plain_id(skewed):
    inv, con = skewed
    eid = F.col("identifier").cast("bigint")
    dest = inv.filter((eid % 2 == 0) & (eid % 3 != 2) & (F.col("creation_date") > 1705000000))
    src = inv.filter(eid % 2 == 1)
    rows = reconcile.rows_to_copy(dest, src, 1704067200, 1706659200)
    got = rows.count()
    hot = rows.filter(F.col("content_id") == K.PLAIN_CONTENT_ID).count()
    assert hot == src.filter(F.col("content_id") == K.PLAIN_CONTENT_ID).count() > 1000
    want = con.execute("""
        WITH d AS (SELECT DISTINCT content_id FROM inv WHERE identifier::BIGINT % 2 = 0
                     AND identifier::BIGINT % 3 <> 2 AND creation_date > 1705000000 AND creation_date > 1704067200
                     AND creation_date < 1706659200),
             s AS (SELECT DISTINCT content_id FROM inv WHERE identifier::BIGINT % 2 = 1
                     AND creation_date > 1704067200 AND creation_date < 1706658600),
             m AS (SELECT content_id FROM s EXCEPT SELECT content_id FROM d)
        SELECT count(*) FROM inv WHERE identifier::BIGINT % 2 = 1
          AND content_id IN (SELECT content_id FROM m)""").fetchone()[0]
    assert got == want

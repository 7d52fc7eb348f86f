"""Scalar helpers."""
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.functions.columns import (digits_number, normalize_sender, per_30, relative_bound,
                                         sats_from_msat, seconds_between, split_lines)


def test_relative_bounds():
    assert relative_bound(1_000_000, K.TWO_DAYS_SECONDS) == 1_000_000 - 172800
    assert relative_bound(1_000_000, K.TWO_WEEKS_SECONDS) == 1_000_000 - 1209600


def test_scalars(spark):
    df = spark.createDataFrame(
        [(" \t@@Bob\n", 1999, "boost", 61, "ep-007.md", "a\r\nb\n\n"),
         (" Zoë ", 1000, "stream", 59, "x", ""),
         (None, None, None, None, None, "\n")],
        "s string, m long, a string, cd long, f string, t string")
    got = df.select(normalize_sender("s").alias("n"), sats_from_msat("m").alias("sat"),
                    per_30("cd", "a").alias("p"), digits_number("f").alias("d"),
                    split_lines("t").alias("l"),
                    seconds_between(F.timestamp_seconds(F.lit(0)),
                                    F.timestamp_seconds(F.col("cd"))).alias("sec")).collect()
    assert [tuple(r) for r in got] == [
        ("@bob", 1, 2, 7, ["a", "b"], 61),
        ("zoë", 1, None, None, [""], 59),
        (None, None, None, None, [], None),
    ]


def test_report_request_defaults(spark):
    from helpers import boost, invoices
    from satledger.plans import params as P
    from satledger.plans.request import report_for_request, resolve_show

    assert resolve_show("Beta", P.SHOWS) == "(?i)beta .*"
    assert resolve_show("(?i).*x.*", P.SHOWS) == "(?i).*x.*" and resolve_show(None, {}) == ".*"
    inv = invoices(spark, [boost(1, 1_000_000, "a", 5), boost(2, 1_000_000 - 1_300_000, "b", 5)])
    lines = report_for_request(inv, "Alpha", None, as_of=1_000_100, shows=P.SHOWS)
    text = [r.line for r in lines.collect()]
    assert any(t.startswith("### From: a") for t in text)
    assert not any(t.startswith("### From: b") for t in text)

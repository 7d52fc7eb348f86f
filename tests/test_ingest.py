"""Golden micro-fixtures for ingest (FIXTURES.md section 7)."""
import json

from pyspark.sql import functions as F

from helpers import b64, boostagram, node_invoice
from satledger.operators.ingest import normalize, parse_node_pages, parse_wallet_pages, quarantine

PLAIN_ID = "a453c4f4c4b8f0c24bb773c31918b1f9da54669808ab34813e67061ceb342af0"


def raw(spark, texts, source="node_a"):
    return spark.createDataFrame([(source, t) for t in texts], "source string, raw string")


def one(spark, text, source="node_a"):
    return normalize(raw(spark, [text], source)).first()


def test_good_payload(spark):
    p = boostagram(action="boost", sender_name="\t@Al Ice ", value_msat_total=1500, message="",
                   podcast="P", app_name="A")
    r = one(spark, node_invoice("42", "1725148800", p))
    assert r.identifier == "42" and r.add_index == 42
    assert r.sender_name == "\t@Al Ice " and r.sender_name_normalized == "al ice"
    assert r.value_msat_total == 1500 and r.value_sat_total == 1
    assert r.message is None
    assert r.action == "boost" and r.podcast == "P" and r.app_name == "A"


def test_no_htlc_keeps_row(spark):
    r = one(spark, node_invoice("7", "1725148800", htlcs=False))
    assert r.identifier == "7" and r.action is None and r.content_id == PLAIN_ID


def test_bad_payloads_keep_row_and_quarantine(spark):
    texts = [node_invoice("1", "1725148800", "@@@"), node_invoice("2", "1725148800", b64("{"))]
    rows = normalize(raw(spark, texts)).orderBy("identifier").collect()
    assert [r.identifier for r in rows] == ["1", "2"]
    assert all(r.action is None and r.sender_name is None for r in rows)
    q = {r.identifier: r.reason for r in quarantine(raw(spark, texts)).collect()}
    assert q == {"1": "boost_base64", "2": "boost_json"}


def test_epoch_string_int_junk(spark):
    texts = [node_invoice("1", "1725148800"), node_invoice("2", 1725148800), node_invoice("3", "x")]
    got = {r.identifier: r.creation_date for r in normalize(raw(spark, texts)).collect()}
    assert got == {"1": 1725148800, "2": 1725148800, "3": None}


def test_created_at_derived_and_parsed(spark):
    a = one(spark, node_invoice("1", "1725148800"))
    w = json.dumps({"identifier": "w1", "creation_date": 1, "created_at": "2024-09-01T00:00:00Z"})
    b = one(spark, w, "wallet")
    got = spark.createDataFrame([(a.created_at,), (b.created_at,)], "t timestamp") \
        .select(F.unix_seconds("t").alias("e")).collect()
    assert [r.e for r in got] == [1725148800, 1725148800]


def test_created_at_without_offset_is_utc(spark):
    texts = [json.dumps({"identifier": "a", "creation_date": 1, "created_at": "2024-09-01T00:00:00"}),
             json.dumps({"identifier": "b", "creation_date": 1, "created_at": "2024-09-01T02:00:00+02:00"}),
             json.dumps({"identifier": "c", "creation_date": 1, "created_at": "2024-09-01T00:00:00.5Z"})]
    got = normalize(raw(spark, texts, "wallet")).select("identifier", F.unix_seconds("created_at").alias("e"))
    assert sorted(map(tuple, got.collect())) == [("a", 1725148800), ("b", 1725148800), ("c", 1725148800)]


def test_page_progress_observation(spark):
    from satledger.operators.ingest import page_progress

    df = normalize(raw(spark, [node_invoice("1", "100"), node_invoice("2", "300")]))
    observed, obs = page_progress(df)
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"min_creation_date": 100, "max_creation_date": 300, "rows": 2}


def test_plain_invoice_content_id(spark):
    assert one(spark, node_invoice("9", "1725148800")).content_id == PLAIN_ID


def test_double_at(spark):
    r = one(spark, node_invoice("1", "1", boostagram(sender_name="@@x")))
    assert r.sender_name_normalized == "@x"


def test_blank_but_not_empty_sender_survives(spark):
    r = one(spark, node_invoice("1", "1", boostagram(sender_name="  ")))
    assert r.sender_name == "  " and r.sender_name_normalized == ""


def test_keysend_and_extra(spark):
    t = node_invoice("1", "1", boostagram(action="boost", foo={"bar": 1}, ts=12),
                     keysend=b64("hello"), memo="", r_hash="abc", features={"x": 1})
    r = one(spark, t)
    assert r.keysend == "hello" and r.memo is None and r.ts == "12"
    assert r.extra == {"invoice/r_hash": "abc", "foo/bar": "1"}


def test_open_schema_flattening(spark):
    t = node_invoice("1", "1", boostagram(action="boost", a={"b": {"c": {"d": {"e": {"f": 1}}}}, "x": [1, 2]},
                                          empty={}, n=None, s="{not json"),
                     dest={"pub": "k", "routes": []})
    r = one(spark, t)
    assert r.extra == {"a/b/c/d/e/f": "1", "a/x": "[1,2]", "boostagram/empty": "{}",
                       "boostagram/s": "{not json", "dest/pub": "k", "dest/routes": "[]"}


def test_content_id_uses_json_text(spark):
    import hashlib

    r = one(spark, node_invoice("1", "1", boostagram(action="boost", podcast="P", sender_name=" S",
                                                     value_msat_total=2500, time="00:01:02")))
    text = " ".join(["boost", "", "", "", "P", "", "", " S", "2500", "", "", "", "", "00:01:02"])
    assert r.content_id == hashlib.sha256(text.encode()).hexdigest()


def test_pages_round_trip(spark):
    node_page = json.dumps({"first_index_offset": "5", "invoices": [
        json.loads(node_invoice("5", "10")), json.loads(node_invoice("6", "11"))]})
    wallet_page = json.dumps([{"identifier": "a", "creation_date": 1,
                               "boostagram": {"action": "stream", "value_msat_total": 3000}}])
    n = parse_node_pages(spark.createDataFrame([(node_page,)], "value string"))
    w = parse_wallet_pages(spark.createDataFrame([(wallet_page,)], "value string"))
    assert sorted(r.identifier for r in normalize(n, "node_a").collect()) == ["5", "6"]
    r = normalize(w, "wallet").first()
    assert (r.identifier, r.action, r.value_sat_total) == ("a", "stream", 3)


def test_payload_and_inline_boostagram_together(spark):
    t = json.dumps({"identifier": "w", "creation_date": 1,
                    "boostagram": {"action": "stream", "app_name": "inline", "foo": "x"},
                    "htlcs": [{"custom_records": {"7629169": boostagram(action="boost", foo="y")}}]})
    r = one(spark, t, "wallet")
    assert (r.action, r.app_name) == ("boost", "inline")
    assert r.extra == {"boostagram/foo": "y"}


def test_bad_amount_kept_and_quarantined(spark):
    """A non-numeric amount does not abort the batch."""
    texts = [node_invoice("1", "5", boostagram(action="boost", value_msat_total="lots")),
             node_invoice("2", "6", boostagram(action="boost", value_msat_total=3000))]
    rows = {r.identifier: r.value_sat_total for r in normalize(raw(spark, texts)).collect()}
    assert rows == {"1": None, "2": 3}
    q = [(r.identifier, r.reason) for r in quarantine(raw(spark, texts)).collect()]
    assert q == [("1", "amount")]


def test_empty_page(spark):
    """An empty page (or one without event times) yields no rows."""
    pages = spark.createDataFrame([('{"first_index_offset": "0", "invoices": []}',)], "value string")
    assert normalize(parse_node_pages(pages), "node_a").count() == 0
    wallet = spark.createDataFrame([("[]",)], "value string")
    assert normalize(parse_wallet_pages(wallet), "wallet").count() == 0


def test_flatten_to_full_depth(spark):
    value = 1
    for level in range(20, 0, -1):
        value = {f"k{level}": value, f"n{level}": "{}"}
    r = one(spark, node_invoice("1", "1", boostagram(action="boost", foo=value)))
    path = "foo/" + "/".join(f"k{i}" for i in range(1, 21))
    assert r.extra[path] == "1" and r.extra["foo/k1/k2/n3"] == "{}" and len(r.extra) == 21


def test_no_record_ends_the_job_or_escapes(spark):
    """On a bare session: amounts, epochs, repeated keys, cut and pretty pages, keysend."""
    policy = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        invoices = [node_invoice("1", "5", boostagram(value_msat_total="1e30")), node_invoice("2", "5", boostagram(value_msat_total="NaN")),
                    node_invoice("3", "1725148800000000000"), '{"add_index":"4","creation_date":"7","x":"1","x":"2","memo":"a","memo":"b"}',
                    node_invoice("5", "5", keysend="***"), '{"creation_date":"9"}', "{cut"]
        whole = '{"invoices":[' + ",".join(json.dumps(i) for i in invoices) + "]}"
        pages = spark.createDataFrame([(whole,), ('{"invoices":[{"add_index":"8"},{"add_',), ("{",), ('  "invoices": []',), ("}",), ("",)], "value string")
        parsed = parse_node_pages(pages).withColumn("source", F.lit("node_a"))
        rows = {r.identifier: r for r in normalize(parsed).collect()}
        failed = sorted((r.reason, r.identifier or r.raw) for r in quarantine(parsed).collect())
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
    assert rows["1"].value_msat_total is None and rows["2"].value_msat_total is None
    assert rows["3"].creation_date == 1725148800000000000 and rows["3"].created_at is None
    assert rows["4"].memo == "b" and rows["4"].extra == {"invoice/x": "2"}
    assert len(rows) == 7 and sum(i.startswith("raw:") for i in rows) == 2
    assert [f for f in failed if f[0] != "page"] == [("amount", "1"), ("amount", "2"), ("creation_date", "3"),
                                                    ("invoice_json", next(i for i in rows if i.startswith("raw:") and rows[i].creation_date is None)),
                                                    ("keysend_base64", "5")]
    assert [f[1] for f in failed if f[0] == "page"] == ['  "invoices": []', "{", '{"invoices":[{"add_index":"8"},{"add_', "}"]


def test_load_since_mark_keeps_rows_without_time_or_mark(spark):
    from satledger.operators.merge import load_since_mark

    raw_rows = spark.createDataFrame([("a", "1", 5), ("a", "2", 15), ("a", "3", None), ("new", "4", 1)], "source string, identifier string, creation_date bigint")
    marks = spark.createDataFrame([("a", 10)], "source string, hwm bigint")
    assert sorted(r.identifier for r in load_since_mark(raw_rows, marks).collect()) == ["2", "3", "4"]

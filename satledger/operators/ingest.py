"""Ingest normalisation (I1-I17): raw invoice JSON -> typed ``invoices`` rows.

A raw invoice is kept as its JSON text, so the open schema survives: the
top-level keys are read with ``from_json(.., map<string,string>)`` (nested
objects stay JSON text), the known ones become typed columns and the rest go
to ``extra``.  The boostagram of a node invoice sits base64-encoded in the
first HTLC's custom records; ``try_to_binary`` decodes it without raising, so
bad payloads give NULL columns plus a quarantine row instead of a failed job.

``normalize`` is one narrow projection: no shuffle, no Python.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satledger import constants as K
from satledger import schemas as S
from satledger.functions.columns import blank_to_null, content_id, normalize_sender, sats_from_msat
from satledger.sources.store import EPOCHS

MAP = "map<string,string>"


PAGE = "broken_page"
#: Newest event time of a row's page.
NEWEST = "page_newest"


def _parsed(pages: DataFrame, text: str, invoices: Column) -> DataFrame:
    """One row per invoice with its JSON text (``raw``), place (``pos``) and the newest event time
    of its page; a page that does not parse is one row with its text in ``broken_page`` and no ``raw``."""
    time = lambda r: blank_to_null(F.get_json_object(r, "$.creation_date")).try_cast("bigint")
    pages = pages.withColumn(NEWEST, F.array_max(F.transform(invoices, time)))
    keep = [c for c in pages.columns if c != text]
    item = f"struct<raw:string,{PAGE}:string>"
    broken = F.array(F.struct(F.lit(None).cast("string").alias("raw"), F.col(text).alias(PAGE)))
    rows = F.when(F.trim(F.col(text)) == "", F.array().cast(f"array<{item}>")) \
        .when(F.col("_invoices").isNull(), broken) \
        .otherwise(F.transform("_invoices", lambda r: F.struct(r.alias("raw"), F.lit(None).cast("string").alias(PAGE))))
    return (pages.withColumn("_invoices", invoices).select(*keep, F.posexplode(rows).alias("pos", "_row"))
            .select(*keep, "pos", F.col("_row.raw").alias("raw"), F.col(f"_row.{PAGE}").alias(PAGE)))


def parse_node_pages(pages: DataFrame, text: str = "value") -> DataFrame:
    """Node pages ``{"first_index_offset":..,"invoices":[..]}`` -> one
    row per invoice, and one per broken page."""
    return _parsed(pages, text, F.from_json(F.col(text), S.NODE_PAGE)["invoices"])


def parse_wallet_pages(pages: DataFrame, text: str = "value") -> DataFrame:
    """Wallet pages (a JSON array of invoices) -> one row per invoice, and one
    per broken page."""
    return _parsed(pages, text, F.from_json(F.col(text), "array<string>"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_wins(m: Column) -> Column:
    """Entries of a parsed object; a repeated key keeps its last value, whatever
    the session's map policy."""
    entries = F.map_entries(m)
    distinct = F.filter(entries, lambda e, i: i == F.size(m) - F.array_position(F.reverse(F.map_keys(m)), e["key"]).cast("int"))
    return F.when(F.size(F.array_distinct(F.map_keys(m))) == F.size(m), entries).otherwise(distinct)


def _object(text: Column) -> Column:
    """A JSON object as a map of texts, NULL when it is none."""
    return _let(F.from_json(text, MAP), lambda m: F.when(m.isNotNull(), F.map_from_entries(_last_wins(m))))


def _decoded_text(b64: Column) -> Column:
    """base64 -> UTF-8 text (invalid bytes replaced), NULL when not base64."""
    raw = F.try_to_binary(b64, F.lit("base64"))
    return F.when(raw.isNotNull(), F.make_valid_utf8(raw.cast("string")))


def _stage(raw: DataFrame) -> DataFrame:
    """Intermediate columns shared by ``normalize`` and ``quarantine``."""
    raw = raw.withColumn("_top", _object(F.col("raw")))
    top = F.col("_top")
    htlcs = F.from_json(top["htlcs"], S.HTLCS)
    records = F.get(htlcs, F.lit(0))["custom_records"]
    boost_b64 = blank_to_null(F.try_element_at(records, F.lit(K.BOOSTAGRAM_TLV)))
    keysend_b64 = blank_to_null(F.try_element_at(records, F.lit(K.KEYSEND_TLV)))
    return raw.select(
        "*",
        boost_b64.alias("_boost_b64"),
        keysend_b64.alias("_keysend_b64"),
    ).select(
        "*",
        _decoded_text(F.col("_boost_b64")).alias("_boost_text"),
        _decoded_text(F.col("_keysend_b64")).alias("_keysend"),
    ).select(
        "*",
        _object(F.col("_boost_text")).alias("_tlv"),
        _object(F.col("_top")["boostagram"]).alias("_wallet"),
    )


def _instant(text: Column) -> Column:
    """ISO-8601 text -> TIMESTAMP; a date-time without an offset is UTC (as
    the reference reads it), never the session zone."""
    no_zone = text.rlike(r"T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$")
    return F.try_to_timestamp(F.when(no_zone, F.concat(text, F.lit("Z"))).otherwise(text))


def _field(name: str) -> Column:
    """Decoded payload wins over the wallet's inline boostagram."""
    return F.coalesce(blank_to_null(F.col("_tlv")[name]), blank_to_null(F.col("_wallet")[name]))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _opened(e: Column, otherwise: Column) -> Column:
    """The entries ``key/sub`` of an entry that holds a JSON object with keys;
    lists, empty objects and scalars stay as ``otherwise``."""
    inner = _let(F.from_json(F.when(e["value"].startswith("{"), e["value"]), MAP), lambda m: F.when(F.size(m) > 0, _last_wins(m)))
    subs = F.transform(inner, lambda s: _entry(F.concat(e["key"], F.lit("/"), s["key"]), s["value"]))
    return F.coalesce(subs, F.array(otherwise))


def _namespaced(m: Column, namespace: str) -> Column:
    """I2 + I3: scalar keys go under ``namespace/``; a key holding an object becomes
    its own namespace and is flattened to ``key/sub/...`` to its full depth: as
    many rounds as the row's texts have braces.  Keys that meet in one path keep
    the last value."""
    entries = F.flatten(F.transform(F.map_entries(m), lambda e: _opened(
        e, _entry(F.concat(F.lit(namespace + "/"), e["key"]), e["value"]))))

    def deeper(found: Column) -> Column:
        braces = F.aggregate(found, F.lit(0), lambda n, e: n + F.coalesce(F.when(
            e["value"].startswith("{"), F.length(F.regexp_replace(e["value"], r"[^{]", ""))), F.lit(0)))
        return _let(braces, lambda n: F.when(n == 0, found).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))), found, lambda acc, _: F.flatten(F.transform(acc, lambda e: _opened(e, e))))))

    def unique(found: Column) -> Column:
        keys = F.transform(found, lambda e: e["key"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), found).otherwise(F.filter(
            found, lambda e, i: i == F.size(found) - F.array_position(F.reverse(keys), e["key"]).cast("int")))

    return F.map_from_entries(_let(_let(entries, deeper), unique))


def _extra() -> Column:
    """I2/I3 open schema: unknown keys, namespaced and flattened; NULL when
    there are none."""
    known_top = S.KNOWN_INVOICE_KEYS + S.DROPPED_INVOICE_KEYS
    top = F.map_filter(F.col("_top"), lambda k, v: ~k.isin(known_top) & v.isNotNull() & (v != ""))
    tlv = F.coalesce(F.col("_tlv"), F.create_map().cast(MAP))
    wallet = F.coalesce(F.col("_wallet"), F.create_map().cast(MAP))
    # Decoded payload wins; keys are made disjoint first, because map_concat
    # raises on duplicate keys under the default dedup policy.
    wallet = F.map_filter(wallet, lambda k, v: ~F.array_contains(F.map_keys(tlv), k))
    boost = F.map_concat(tlv, wallet)
    boost = F.map_filter(boost, lambda k, v: ~k.isin(S.BOOSTAGRAM_FIELDS) & v.isNotNull() & (v != ""))
    top_flat = _namespaced(top, "invoice")
    # A nested namespace may repeat in both parts; the decoded payload wins.
    merged = _let(_namespaced(boost, "boostagram"), lambda b: _let(F.map_keys(b), lambda keys: F.map_concat(
        b, F.map_filter(top_flat, lambda k, v: ~F.array_contains(keys, k)))))
    return _let(merged, lambda m: F.when(F.size(m) > 0, m))


def open_keys(norm: DataFrame, *keep: str) -> DataFrame:
    """One row per key of the open schema: ``keep``, ``name``, ``value``.

    An inner ``explode`` would have Spark filter on ``extra`` below the projection that
    computes it, and flatten each row three times."""
    rows = norm.select(*keep, F.explode_outer("extra").alias("name", "value"))
    return rows.filter(F.col("name").isNotNull())


def _whole_number(text: Column) -> Column:
    """An amount text as BIGINT; NULL when it is no number or too large for one."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def _identifier(top: Column) -> Column:
    """I5; an invoice without any gets a content-derived one, so that it is kept
    apart from others and lands once however often it is loaded."""
    return F.coalesce(blank_to_null(top["add_index"]), blank_to_null(top["identifier"]),
                      F.concat(F.lit("raw:"), F.sha2(F.col("raw"), 256)))


def _with_page(raw: DataFrame) -> DataFrame:
    return raw if PAGE in raw.columns else raw.withColumn(PAGE, F.lit(None).cast("string"))


def normalize(raw: DataFrame, source: str | Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """I1-I15 over rows with a ``raw`` invoice JSON column (broken pages are left to
    ``quarantine``).  ``keep``: columns of ``raw`` to carry along.

    ``source`` (I15) tags the upstream; by default the ``source`` column of
    ``raw`` is used."""
    src = F.lit(source) if isinstance(source, str) else (source if source is not None
                                                            else F.col("source"))
    st = _stage(_with_page(raw.withColumn("_src", src)).filter(F.col(PAGE).isNull()))
    top = F.col("_top")
    add_index_text = blank_to_null(top["add_index"])
    cd = blank_to_null(top["creation_date"]).try_cast("bigint")
    msat_text = _field("value_msat_total")
    msat = _whole_number(msat_text)
    fields = {n: _field(n) for n in S.BOOSTAGRAM_STRING_FIELDS}
    cols = {
        "source": F.col("_src"),
        "identifier": _identifier(top),
        "invoice_source": blank_to_null(top["source"]),
        "creation_date": cd,
        "created_at": F.coalesce(_instant(blank_to_null(top["created_at"])),
                                 F.timestamp_seconds(F.when(cd.between(*EPOCHS), cd))),
        "add_index": add_index_text.try_cast("bigint"),
        "comment": blank_to_null(top["comment"]),
        "memo": blank_to_null(top["memo"]),
        "keysend": blank_to_null(F.col("_keysend")),
        **fields,
        "sender_name_normalized": normalize_sender(fields["sender_name"]),
        "value_msat_total": msat,
        "value_sat_total": sats_from_msat(msat),
        "content_id": content_id({**fields, "value_msat_total": msat_text}),
        "extra": _extra(),
    }
    return st.select(*[cols[n].alias(n) for n in S.INVOICE_COLUMNS], *keep)


def quarantine(raw: DataFrame, source: str | Column | None = None) -> DataFrame:
    """Pages and rows whose payload or numbers could not be decoded, with the reason.

    The invoice itself is still kept by ``normalize`` (with NULL boost
    columns), as in the reference."""
    src = F.lit(source) if isinstance(source, str) else (source if source is not None
                                                            else F.col("source"))
    st = _stage(_with_page(raw.withColumn("_src", src)))
    top = F.col("_top")
    msat_text = _field("value_msat_total")
    cd_text = blank_to_null(top["creation_date"])
    reason = F.concat_ws(",", F.array_compact(F.array(
        F.when(F.col(PAGE).isNotNull(), F.lit("page")),
        F.when(F.col(PAGE).isNull() & top.isNull(), F.lit("invoice_json")),
        F.when(F.col("_boost_b64").isNotNull() & F.col("_boost_text").isNull(), F.lit("boost_base64")),
        F.when(F.col("_boost_text").isNotNull() & F.col("_tlv").isNull(), F.lit("boost_json")),
        F.when(F.col("_keysend_b64").isNotNull() & F.col("_keysend").isNull(), F.lit("keysend_base64")),
        F.when(msat_text.isNotNull() & _whole_number(msat_text).isNull(), F.lit("amount")),
        F.when(cd_text.isNotNull() & ~F.coalesce(cd_text.try_cast("bigint").between(*EPOCHS), F.lit(False)), F.lit("creation_date")),
    )))
    # A filter on ``reason`` would be pushed below the projection with the
    # JSON parsing inlined into it (filters get no common-subexpression
    # elimination); a generator keeps the parse in one projection.
    staged = st.select(
        F.col("_src").alias("source"),
        F.when(F.col(PAGE).isNull(), _identifier(top)).alias("identifier"),
        reason.alias("_reason"),
        F.coalesce("raw", PAGE).alias("raw"),
    )
    return staged.select("source", "identifier", F.explode(
        F.when(F.col("_reason") != "", F.array(F.col("_reason")))).alias("reason"), "raw")


def page_progress(raw_norm: DataFrame, name: str = "page_progress"):
    """Min / max event time and row count of an ingest batch, as an
    ``Observation`` filled when the batch is written."""
    from pyspark.sql import Observation

    obs = Observation(name)
    observed = raw_norm.observe(obs, F.min("creation_date").alias("min_creation_date"),
                                F.max("creation_date").alias("max_creation_date"),
                                F.count(F.lit(1)).alias("rows"))
    return observed, obs

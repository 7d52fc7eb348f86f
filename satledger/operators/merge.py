"""Attribute-level upsert (N6), delete (N13), high-water mark.

Identity is ``(source, identifier)`` (H1: node identifiers are per-node
counters, so the identifier alone can merge unrelated invoices)."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.schemas import KEY

SEQ = "_seq"


def newest_versions(new: DataFrame, seq: str, key: Iterable[str] = KEY) -> DataFrame:
    """One row per key: per attribute the non-NULL value of the highest ``seq``."""
    key = list(key)
    cols = [c for c in new.columns if c not in (*key, seq)]
    return new.groupBy(*key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])


def coalesced(old: DataFrame, newest: DataFrame, key: Iterable[str] = KEY) -> DataFrame:
    """``newest`` over ``old``, both one row per key: a full outer join that takes
    ``coalesce(new, old)`` per attribute and reads each side once.  NULL key parts
    are equal to each other."""
    key = list(key)
    o = old.select(*[F.col(c).alias(f"_old_{c}") for c in old.columns], F.lit(1).alias("_has_old"))
    cond = F.lit(True)
    for c in key:
        cond = cond & newest[c].eqNullSafe(o[f"_old_{c}"])
    joined = newest.join(o, cond, "full")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in old.columns])


def upsert(old: DataFrame, new: DataFrame, seq: str, key: Iterable[str] = KEY) -> DataFrame:
    """Newer non-NULL attribute values replace older ones; an attribute
    that is absent (NULL) in the newer version keeps the older value.

    ``seq`` names the ordering column of ``new``: several versions of a key in
    one batch are collapsed in its order first.  Every ``new`` row outranks
    ``old``.  The store side is scanned once and never regrouped."""
    cols = [c for c in old.columns if c != seq]
    newest = newest_versions(new.select(*cols, seq), seq, key)
    return coalesced(old.select(*cols), newest.select(*cols), key)


def delete_keys(inv: DataFrame, keys: DataFrame, key: Iterable[str] = KEY) -> DataFrame:
    """Retract invoices by key (anti join; AQE turns it into a broadcast
    when the key set is small at run time)."""
    key = list(key)
    return inv.join(keys.select(*key).distinct(), key, "left_anti")


def high_water_marks(inv: DataFrame, spark: SparkSession | None = None,
                     sources: list[str] | None = None,
                     start: int = K.AUTOSCRAPE_START) -> DataFrame:
    """Newest event time per source, ``start`` for an empty source.

    The cursor is per source (H3), so synced rows from another source never
    move it."""
    marks = inv.groupBy("source").agg(F.max("creation_date").alias("hwm"))
    if sources:
        spark = spark or inv.sparkSession
        names = F.broadcast(spark.createDataFrame([(s,) for s in sources], "source string"))
        marks = names.join(marks, "source", "left")
    return marks.select("source", F.coalesce("hwm", F.lit(start).cast("bigint")).alias("hwm"))


def load_since_mark(raw: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of a landed batch at or after their source's mark (the page
    boundary overlap is harmless because the merge is an upsert).  Rows without an
    event time and rows of a source without a mark are loaded: only a time
    before the mark tells that a row is known."""
    known = raw["creation_date"] < marks["hwm"]
    return (raw.join(F.broadcast(marks), raw["source"].eqNullSafe(marks["source"]), "left")
            .filter(~F.coalesce(known, F.lit(False))).select(*[raw[c] for c in raw.columns]))


def load_until_epoch(rows: DataFrame, marks: DataFrame, page: str = "page") -> DataFrame:
    """Whole pages, newest first, up to the first page whose newest event time lies
    before its source's mark; that page and all behind it stay out.

    ``page`` numbers the pages of a source in the order they are fetched.  A page that
    straddles the mark counts whole, so that a changed row with an old time is loaded;
    a page without event times stops nothing; a source without a mark is loaded whole.
    ``marks`` (``source``, ``hwm``) has a row per source."""
    newest = rows.groupBy("source", page).agg(F.max("creation_date").alias("newest"))
    known = F.broadcast(marks.select(F.col("source").alias("_of"), "hwm"))
    stop = (newest.join(known, F.col("source").eqNullSafe(F.col("_of"))).filter(F.col("newest") < F.col("hwm"))
            .groupBy("_of").agg(F.min(page).alias("_stop")))  # at most a row per source
    return (rows.join(F.broadcast(stop), rows["source"].eqNullSafe(F.col("_of")), "left")
            .filter(F.col("_stop").isNull() | (rows[page] < F.col("_stop"))).select(*[rows[c] for c in rows.columns]))

"""Reconciliation of stores by content hash.

Nothing is collected: id sets are distinct DataFrames, the difference is an
anti join and the copy a semi join.  The constant hash of plain invoices (H2)
is a hot key; both sides are de-duplicated to one row per id *before* the
anti join (map-side partial aggregation collapses the hot key), and AQE's skew
handling splits the hot partition of the semi join."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satledger import constants as K
from satledger.sources.store import packed, prune_days, unpacked


def content_ids_between(inv: DataFrame, since: int, stop: int,
                        include_plain: bool = True) -> DataFrame:
    """Distinct content ids with ``since < creation_date < stop``."""
    cond = (F.col("creation_date") > since) & (F.col("creation_date") < stop) \
        & F.col("content_id").isNotNull()
    if not include_plain:
        cond = cond & F.col("action").isNotNull()
    return prune_days(inv, since, stop).filter(cond).select("content_id").distinct()


def missing_content_ids(dest: DataFrame, src: DataFrame, since: int, as_of: int,
                        hold_back: int = K.HOLD_BACK_SECONDS,
                        include_plain: bool = True) -> DataFrame:
    """N8 + N10: ids of ``src`` in ``(since, as_of - hold_back)`` absent from
    ``dest`` in ``(since, as_of)``.  The hold-back applies to the source only."""
    src_ids = content_ids_between(src, since, as_of - hold_back, include_plain)
    dest_ids = content_ids_between(dest, since, as_of, include_plain)
    return src_ids.join(dest_ids, "content_id", "left_anti")


def sync_counts(dest: DataFrame, src: DataFrame, since: int, as_of: int,
                hold_back: int = K.HOLD_BACK_SECONDS, include_plain: bool = True) -> DataFrame:
    """Sizes of the destination set, the source set and the difference."""
    src_ids = content_ids_between(src, since, as_of - hold_back, include_plain)
    dest_ids = content_ids_between(dest, since, as_of, include_plain)
    flagged = (src_ids.select("content_id", F.lit(1).alias("in_src"))
               .join(dest_ids.select("content_id", F.lit(1).alias("in_dest")), "content_id", "full"))
    return flagged.agg(
        F.count("in_dest").alias("destination_ids"),
        F.count("in_src").alias("source_ids"),
        F.count_if(F.col("in_src").isNotNull() & F.col("in_dest").isNull()).alias("unique_to_source"))


HOT_ID_SALTS = 1024


def rows_to_copy(dest: DataFrame, src: DataFrame, since: int, as_of: int,
                 hold_back: int = K.HOLD_BACK_SECONDS, include_plain: bool = True,
                 salts: int = HOT_ID_SALTS) -> DataFrame:
    """N9 + N11: every ``src`` row carrying a missing id - including rows
    outside the window, as in the reference.

    The plain-invoice id (H2) can carry a third of all rows, so the semi join
    is salted for it: source rows with that id get a salt from their key
    (``salts`` buckets), and only that one id is replicated over the salts on
    the missing-id side.  Every other id keeps salt 0.  One pass over the
    source, and the hot id is spread over ``salts`` join keys."""
    return rows_with_ids(src, missing_content_ids(dest, src, since, as_of, hold_back, include_plain), salts)


def rows_with_ids(src: DataFrame, missing: DataFrame, salts: int = HOT_ID_SALTS) -> DataFrame:
    """The rows of ``src`` that carry one of the content ids of ``missing`` (as texts or packed)."""
    if dict(missing.dtypes)["content_id"] == "string":
        missing = missing.filter(F.col("content_id").isNotNull()).withColumn("content_id", packed())
    plain_id = F.lit(bytearray.fromhex(K.PLAIN_CONTENT_ID))
    plain = F.col("content_id") == plain_id
    salted_src = src.withColumn("content_id", packed()).withColumn(
        "_salt", F.when(plain, F.pmod(F.xxhash64("source", "identifier"), F.lit(salts)))
        .otherwise(F.lit(0)).cast("bigint"))
    salted_ids = missing.withColumn("_salt", F.explode(
        F.when(plain, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        .otherwise(F.array(F.lit(0).cast("bigint")))))
    found = salted_src.join(salted_ids, ["content_id", "_salt"], "left_semi")
    return found.withColumn("content_id", unpacked()).select(*src.columns)


def reconcile(dest: DataFrame, src: DataFrame, since: int, as_of: int,
              hold_back: int = K.HOLD_BACK_SECONDS, include_plain: bool = True) -> DataFrame:
    """The destination after copying the missing rows in (upsert on key;
    ``src`` has one row per key)."""
    from satledger.operators.merge import coalesced

    copy = rows_to_copy(dest, src, since, as_of, hold_back, include_plain).select(*dest.columns)
    return coalesced(dest, copy)


def find_similar(inv: DataFrame, action: str, sender: str, timestamp: int, delta: int) -> DataFrame:
    """N12 point form: same action and sender within ``[t - d, t + d]``."""
    return prune_days(inv, timestamp - delta, timestamp + delta).filter(
        (F.col("action") == F.lit(action))
                      & (F.col("sender_name_normalized") == F.lit(sender))
                      & F.col("creation_date").between(timestamp - delta, timestamp + delta))


def similar_counts(inv: DataFrame, delta: int, action: str | None = None) -> DataFrame:
    """N12 batch form: each payment that has others of its action and sender within
    ``delta`` seconds, with their number and the time to the nearest.

    The payments of a sender are first counted per second; a window then runs over
    the seconds of one bucket of ``delta`` and its two neighbours, so no partition
    holds more than three ``delta`` rows, and the output is linear in the input."""
    cond = F.col("action").isNotNull() & F.col("sender_name_normalized").isNotNull() & F.col("creation_date").isNotNull()
    if action is not None:
        cond = cond & (F.col("action") == F.lit(action))
    base = inv.filter(cond).select("action", F.col("sender_name_normalized").alias("sender"), "source", "identifier", "creation_date")
    key = ["action", "sender", "creation_date"]
    home = F.floor(F.col("creation_date") / F.lit(max(delta, 1))).cast("bigint")
    seconds = base.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("home", home)
    spread = seconds.withColumn("bucket", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)))
    order = Window.partitionBy("action", "sender", "bucket").orderBy("creation_date")
    gap = F.least(F.col("creation_date") - F.lag("creation_date").over(order), F.lead("creation_date").over(order) - F.col("creation_date"))
    near = spread.select(*key, "home", "bucket", (F.sum("n").over(order.rangeBetween(-delta, delta)) - 1).alias("neighbours"),
                         F.when(F.col("n") > 1, F.lit(0).cast("bigint")).otherwise(gap).alias("nearest"))
    near = near.filter((F.col("bucket") == F.col("home")) & (F.col("neighbours") > 0)).drop("home", "bucket")
    return base.join(near, key).select("action", "sender", "source", "identifier", "creation_date", "neighbours", "nearest")

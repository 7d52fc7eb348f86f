"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame only).

Rows are put in one global order (content hash, id), dealt by range.  Each
range's byte total is small data; its prefix sums plus a running sum inside the
range give every row its global byte offset, and cutting the offsets at equal
targets gives contiguous shards.  The hot case is harmless: equal contents
differ in the id, so a range boundary can fall between them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satledger.llm.common import keyed, spread, store

#: Ranges are broadcast up to this number (24 bytes each); beyond it they are joined.
BROADCAST_RANGES = 200_000
#: What a row takes while it is ordered: sizes the ranges.
ROW_BYTES = 64


def shard_at(offset: Column, total: int, n_shards: int) -> Column:
    """``floor(offset * n_shards / total)`` in whole numbers: a fractional decimal
    quotient is rounded to its scale, and just before a cut up to the next shard."""
    scaled = offset.cast("decimal(38,0)") * F.lit(n_shards)
    return F.call_function("div", scaled, F.lit(total or 1).cast("decimal(38,0)")).cast("int")


def byte_shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``.  A row
    goes to shard ``floor(offset * n_shards / total)`` of its global byte offset,
    so shard totals differ from the target by less than one row's size at each
    cut; a row larger than the target leaves shards empty.  ``slot`` counts from
    0 without gaps within a shard.  Equal texts are neighbours: only a group on
    a cut is divided.  Repeated rows count each; null ids come first; an empty table gives
    no rows.  Other columns, whatever their names, are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = store(keyed(docs, id_col, text_col).select(
        "id", (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")), "shard-sizes")
    # written: the range bounds come from a sample, so the ranges are drawn once
    ranges = spread(narrow, narrow.count() * ROW_BYTES)
    ranged = store(narrow.repartitionByRange(ranges, "h", "id", "row").withColumn("part", F.spark_partition_id()), "shard-ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = store(totals.select("part", "part_size", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("size_before"),
                                 F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before")), "shard-totals")
    total, filled = totals.agg(F.sum("part_size"), F.count("*")).first()
    within = Window.partitionBy("part").orderBy("h", "id", "row")
    before = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.col("size_before") + before
    offsets = ranged.join(F.broadcast(totals) if filled <= BROADCAST_RANGES else totals, "part")
    placed = store(offsets.select(
        "id", "size", "text_crc32", shard_at(offset, total, n_shards).alias("shard"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("place")), "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))

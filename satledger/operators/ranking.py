"""Places in a global order, without a window of one partition."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satledger.session import cut_lineage


def global_rank(df: DataFrame, *order: Column, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the place (from 1) of each row in the order of ``order``,
    which should tell all rows apart.

    Rows are dealt to ranges of the order and sorted inside; a range starts after the
    rows of those before it.  Only the counts of the ranges reach the driver.  The ranges
    are drawn from a sample, so the dealt rows are written once (checkpoint)."""
    here, place = f"{name}__range", f"{name}__place"
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(here, F.spark_partition_id())
    # the number of a row in its range: the lower 33 bits of its id
    dealt = cut_lineage(dealt.withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = {r[here]: r["n"] for r in dealt.groupBy(here).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    start = F.get(F.array(*map(F.lit, starts)).cast("array<bigint>"), F.col(here))
    return dealt.withColumn(name, (start + F.col(place) + 1).cast("bigint")).drop(here, place)

"""Mixing sources to target weights by balanced sampling (cube method).

Each source has a target of words; target / size is the number of copies of
each of its documents.  The whole part is taken outright, the fraction is an
inclusion probability.  The cube method then rounds the probabilities to 0 or 1
while holding the sums of words and of documents: a step moves three units
along the null-space of the two constraints until one of them is settled.

Blocks of a source fly apart from each other and leave at most two units
each; these fly again in the blocks of the next level, until one block per
source is left, whose last two units land on the rounding nearest to the sums.
"""
from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satledger.llm.common import numbered, place, store

#: Units that one flight handles.
BLOCK = 4096
#: Sources up to which a row per source is broadcast.
BROADCAST_SOURCES = 100_000
_NEAR = 1e-9


def flight(sizes: list[int], chances: list[float], rng: random.Random) -> list[int]:
    """Settle ``chances`` (in place) but for at most two units, holding the sum of
    chances and the sum of ``size * chance``; the unsettled units."""
    window: list[int] = []
    for unit in range(len(sizes)):
        if not _NEAR < chances[unit] < 1 - _NEAR:
            chances[unit] = float(round(chances[unit]))
            continue
        window.append(unit)
        if len(window) == 3:
            a, b, c = (sizes[i] for i in window)
            step = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
            up = min(((1 - chances[i]) / s if s > 0 else -chances[i] / s) for i, s in zip(window, step) if s)
            down = min((chances[i] / s if s > 0 else (chances[i] - 1) / s) for i, s in zip(window, step) if s)
            move = up if rng.random() * (up + down) < down else -down
            for i, s in zip(window, step):
                chances[i] += move * s
                if not _NEAR < chances[i] < 1 - _NEAR:
                    chances[i] = float(round(chances[i]))
            window = [i for i in window if 0 < chances[i] < 1]
    return window


def land(units: list[int], sizes: list[int], chances: list[float]) -> None:
    """Round the last units to the corner nearest to both sums, words first."""
    best = None
    for corner in range(1 << len(units)):
        takes = [corner >> j & 1 for j in range(len(units))]
        words = sum(sizes[i] * (t - chances[i]) for i, t in zip(units, takes))
        count = sum(t - chances[i] for i, t in zip(units, takes))
        if best is None or (abs(words), abs(count), corner) < best[:3]:
            best = (abs(words), abs(count), corner, takes)
    for i, t in zip(units, best[3]):
        chances[i] = float(t)


def _fly(seed: int, level: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "size", "row"])
        sizes, chances = group["size"].tolist(), group["chance"].tolist()
        rng = random.Random(f"{seed}:{level}:{group['source_no'].iat[0]}:{group['block'].iat[0]}")
        left = flight(sizes, chances, rng)
        if left and group["blocks"].iat[0] == 1:
            land(left, sizes, chances)
        return group.assign(chance=chances)[["row", "source_no", "size", "draw", "chance"]]

    return run


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """``source, source_no, docs, source_size, target`` from rows of ``source, size``.

    Sources in code-point order, null last, weigh ``weights``, repeating.  Targets
    share the total by weight; a target stops at ``limit`` times its source's size
    and the excess is reshared by weight until none is above: target =
    min(limit, level * weight) for the one level that spends the total.  The table
    has one row per source; a single-partition window over it finds the level (made for
    tens to thousands of sources)."""
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(by_name) - 1
    per = per.withColumn("source_no", no).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    spent, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - spent) / (F.sum("weight").over(everything) - gone)
    per = per.withColumn("level", level).withColumn("turn", F.row_number().over(filling))
    open_ = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("turn", "level"))
    per = per.withColumn("final", F.min(open_).over(everything)["level"])
    return per.select("source", "source_no", "docs", "source_size",
                      F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0, seed: int = 20,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False,
          block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id, source, size, source_size, target, copies``, with
    ``carry`` also ``doc``, the whole row as a struct.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix
    takes the row; a source's ``sum(size * copies)`` differs from its target by
    less than its largest document, and no document has more than
    ``ceil(limit)`` copies.  Null is a source of its own.  Blocks and draws depend
    on ids and sizes only, so reruns agree; repeated rows are interchangeable.
    An empty table gives no rows; extra columns are ignored but for ``carry``."""
    fields = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    rows = numbered(docs).select(*(place(docs, c).alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))),
                                 *([F.struct(*fields).alias("doc")] if carry else []))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    rows = store(rows.select("id", "source", words.alias("size"), F.monotonically_increasing_id().alias("row"),
                             *(["doc"] if carry else [])), "mix-sizes")
    targets = store(source_targets(rows, weights, limit), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + _NEAR)
    named = targets.select(F.col("source").alias("named"), "source_no", "docs", "source_size", "target",
                           whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("chance"))
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    units = rows.where(F.col("chance") > _NEAR).select(
        "row", "source_no", "size", F.xxhash64("id", "size", F.lit(seed)).alias("draw"), "chance")
    settled, level = [], 0
    few = targets.count() <= BROADCAST_SOURCES
    while True:
        counts = units.groupBy("source_no").agg(F.count("*").alias("n")).select(
            "source_no", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        dealt = units.join(F.broadcast(counts) if few else counts, "source_no").withColumn(
            "block", F.pmod(F.xxhash64("draw", "size", F.lit(level)), F.col("blocks")).cast("int"))
        dealt = dealt.repartition("source_no", "block")  # blocks of a source fly in different tasks
        flown = store(dealt.groupBy("source_no", "block").applyInPandas(
            _fly(seed, level), "row bigint, source_no int, size bigint, draw bigint, chance double"), f"mix-level{level}")
        fraction = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.where(~fraction).select("row", F.col("chance").cast("int").alias("extra")))
        units = flown.where(fraction)
        level += 1
        if units.isEmpty():
            break
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    return rows.join(extra, "row", "left").select(
        "id", "source", "size", "source_size", "target", *(["doc"] if carry else []),
        (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("bigint").alias("copies"))

"""Hard negatives by disjoint score slots.

An anchor's positives set windows of scores for its negatives, which overlap.
Their upper limits split the scores into disjoint slots, so one look at a row
finds the one slot that it may enter.  Each task keeps the first ``k`` rows of every
slot, a shuffle by slot keeps the first ``k`` of all tasks, and as a window is the
union of a slot and those below it, merging slots from the lowest one up answers
every window.

Anchors are a stated set of queries against all rows: rows are packed into blocks
and dealt to groups of bounded size, and the blocks of anchors go to every group;
a task holds one group and lets the anchors pass.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from satledger.llm.common import numbered, parallelism, small_batches, store
from satledger.llm.vectors import common_length, matrix

GRID = 256
#: Bytes of packed vectors that a task holds; rows of a packed block; rows that are
#: compared with a block of anchors at a time.
GROUP_BYTES, BLOCK, TILE = 128 << 20, 1024, 8192
#: Whole numbers that a floating-point type holds, in bits.
EXACT = {np.float32: 24, np.float64: 53}
VECTORS = "id bigint, label bigint, x binary, anchor boolean"
BLOCKS = "ids binary, labels binary, keys binary, limits binary, x binary, wide boolean"
FOUND = "key bigint, slot int, score bigint, id bigint"


def _quantise(length: int, grid: int, out: pa.Schema):
    """Whole-number vectors as binary: 16 bits an entry where a batch allows it, else 64."""
    largest = int((2**62 / length) ** 0.5) if length else 0  # so that no product leaves 64 bits
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, values = matrix(batch.column(2), length)
            x = np.floor(grid * np.clip(values, -largest / grid, largest / grid)).astype(np.int64)
            x = np.clip(x, -largest, largest)
            kind = np.int16 if peak(x) < 2**15 else np.int64
            data = np.ascontiguousarray(x.astype(kind))
            cuts = pa.array(np.arange(len(x) + 1) * data.itemsize * length, pa.int32())
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, cuts.buffers()[1], pa.py_buffer(data.tobytes())])
            keep = pa.array(good)
            columns = [batch.column(i).filter(keep) for i in (0, 1)] + [packed, batch.column(3).filter(keep)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return run


def _pack(length: int, limits: int, out: pa.Schema):
    """Blocks of at most ``BLOCK`` rows: ids, labels, keys, limits and vectors side by side."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("x").to_pylist()
            wide = np.array([len(b) != 2 * length for b in raw], bool)
            ints = {c: batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("id", "label", "key")}
            if limits:
                flat = np.array(batch.column("limits").to_pylist(), np.int64).reshape(len(raw), limits)
            rows = []
            for kind in (False, True):
                of = np.flatnonzero(wide == kind)
                for at in range(0, len(of), BLOCK):
                    i = of[at:at + BLOCK]
                    rows.append((*(ints[c][i].tobytes() for c in ("id", "label", "key")), flat[i].tobytes() if limits else b"",
                                 b"".join(raw[j] for j in i.tolist()), kind))
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return run


def packed(rows: DataFrame, length: int, limits: int = 0) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType.fromDDL(BLOCKS)
    return rows.mapInArrow(_pack(length, limits, to_arrow_schema(out)), out)


class _Group:
    """The rows of a group in one order: by label and id, or by id."""

    def __init__(self, blocks: list[tuple], length: int, by_label: bool):
        ids = np.concatenate([np.frombuffer(b[0], np.int64) for b in blocks])
        labels = np.concatenate([np.frombuffer(b[1], np.int64) for b in blocks])
        order = np.lexsort((ids, labels)) if by_label else np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.labels = ids[order], labels[order]
        self.x = np.empty((len(ids), length), np.int64 if any(b[5] for b in blocks) else np.int16)
        at = 0
        while blocks:  # each block goes once it is copied
            part = vectors_of(blocks.pop(0), length)
            self.x[place[at:at + len(part)]] = part
            at += len(part)
        self.peak = peak(self.x)


def vectors_of(block: tuple, length: int) -> np.ndarray:
    return np.frombuffer(block[4], np.int64 if block[5] else np.int16).reshape(-1, length)


def peak(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _kind(length: int, a: int, b: int):
    """The number type in which products of vectors with these peaks are exact."""
    return next((t for t, bits in EXACT.items() if length * a * b < 2**bits), np.int64)


def _lowest(kind):
    return -np.inf if kind != np.int64 else np.iinfo(np.int64).min


class _Best:
    """The first ``k`` rows of each anchor, rows coming in the order that breaks ties."""

    def __init__(self, anchors: int, k: int, kind):
        self.k, self.low = k, _lowest(kind)
        self.scores = np.full((anchors, k), self.low, kind)
        self.ids = np.zeros((anchors, k), np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the anchors (rows) with further rows (columns); ``low``: not offered."""
        some = np.flatnonzero(scores.max(axis=1, initial=self.low) > self.scores[:, -1])
        if not len(some):
            return
        part = scores[some]
        lines = np.arange(len(some))
        new, at = np.empty((len(some), self.k), part.dtype), np.empty((len(some), self.k), np.int64)
        for j in range(self.k):  # the first of equal ones is the one of the smallest id
            at[:, j] = part.argmax(axis=1)
            new[:, j] = part[lines, at[:, j]]
            part[lines, at[:, j]] = self.low
        both = np.hstack([self.scores[some], new])
        names = np.hstack([self.ids[some], ids[at]])
        first = np.argsort(-both, axis=1, kind="stable")[:, :self.k] if both.dtype != np.int64 else np.lexsort(
            (np.broadcast_to(np.arange(2 * self.k), both.shape), ~both), axis=1)[:, :self.k]
        self.scores[some] = np.take_along_axis(both, first, 1)
        self.ids[some] = np.take_along_axis(names, first, 1)

    def rows(self, keys: np.ndarray, slot: int) -> tuple[np.ndarray, ...]:
        line, column = np.nonzero(self.scores > self.low)
        return keys[line], np.full(len(line), slot), self.scores[line, column].astype(np.int64), self.ids[line, column]


def _positives(group: _Group, block: tuple, length: int, k: int) -> list[tuple]:
    """The first ``k`` rows of the group of each anchor's own label, itself left out."""
    ids, labels, keys = (np.frombuffer(b, np.int64) for b in block[:3])
    anchors = vectors_of(block, length)
    kind = _kind(length, group.peak, peak(anchors))
    out = []
    for label in np.unique(labels).tolist():
        of = np.flatnonzero(labels == label)
        a = anchors[of].astype(kind)
        best = _Best(len(of), k, kind)
        first, last = np.searchsorted(group.labels, label, "left"), np.searchsorted(group.labels, label, "right")
        for at in range(first, last, TILE):
            to = min(at + TILE, last)
            scores = a @ group.x[at:to].astype(kind).T
            scores[ids[of][:, None] == group.ids[at:to]] = best.low
            best.offer(scores, group.ids[at:to])
        out.append(best.rows(keys[of], 0))
    return out


def _negatives(group: _Group, block: tuple, length: int, k: int) -> list[tuple]:
    """The first ``k`` rows of the group in each slot of each anchor, rows of its label left out."""
    labels, keys = (np.frombuffer(b, np.int64) for b in block[1:3])
    anchors = vectors_of(block, length)
    kind = _kind(length, group.peak, peak(anchors))
    bounds = np.frombuffer(block[3], np.int64).reshape(len(keys), -1, 2)  # per slot: above, up to
    if kind in EXACT:  # no score lies outside
        bounds = np.clip(bounds, -(1 << EXACT[kind]), 1 << EXACT[kind]).astype(kind)
    slots = [(j, np.flatnonzero(bounds[:, j, 0] < bounds[:, j, 1])) for j in range(bounds.shape[1])]
    slots = [(j, of, _Best(len(of), k, kind)) for j, of in slots if len(of)]
    a = anchors.astype(kind)
    for at in range(0, len(group.ids), TILE):
        scores = a @ group.x[at:at + TILE].astype(kind).T
        scores[labels[:, None] == group.labels[at:at + TILE]] = _lowest(kind)
        for j, of, best in slots:
            above, up_to = bounds[of, j, 0][:, None], bounds[of, j, 1][:, None]
            part = scores if len(of) == len(scores) else scores[of]
            # only what beats the slot's last row so far
            inside = (part <= up_to) & (part > np.maximum(above, best.scores[:, -1:]))
            if inside.any():
                best.offer(np.where(inside, part, kind(best.low)), group.ids[at:at + TILE])
    return [best.rows(keys[of], j) for j, of, best in slots]


def _search(find, length: int, k: int, by_label: bool, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        now, blocks, group = None, [], None
        for batch in batches:
            for number, anchors, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    now, blocks, group = number, [], None
                if not anchors:
                    blocks.append(tuple(block))
                    continue
                if blocks:
                    group = _Group(blocks, length, by_label)
                if group is None:
                    continue  # no rows in this group
                for columns in find(group, tuple(block), length, k):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return run


def _searched(find, rows: DataFrame, anchors: DataFrame, groups: int, length: int, k: int, by_label: bool) -> DataFrame:
    """What ``find`` keeps of each group for each anchor: ``key, slot, score, id``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    dealt = rows.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("number"), F.lit(False).alias("anchors"), "*")
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("number"), F.lit(True).alias("anchors"), "*")
    out = StructType.fromDDL(FOUND)
    both = dealt.unionByName(sent).repartitionById(groups, "number").sortWithinPartitions("number", "anchors")
    return both.mapInArrow(_search(find, length, k, by_label, to_arrow_schema(out)), out)


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    """Per group the first ``k`` of what the tasks kept, in order: ``found``, an array of ``score, id``."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")))
    first = F.transform(F.slice(ordered, 1, k), lambda s: F.struct((-s["minus"]).alias("score"), s["id"].alias("id")))
    return found.groupBy(*by).agg(first.alias("found"))


def _windows(positives: Column, low: int, high: int) -> Column:
    """Per positive its window: scores from ``low`` to ``high`` hundredths of its own."""
    floor = lambda a: F.floor(a / F.lit(100).cast("decimal(3,0)")).cast("bigint")
    score = lambda p: p["score"].cast("decimal(24,0)")
    return F.transform(positives, lambda p: F.struct(p["score"].alias("score"), p["id"].alias("id"),
                                                     (-floor(-score(p) * low)).alias("least"), floor(score(p) * high).alias("most")))


def _bounds(k: int) -> Column:
    """Per slot, flat, the score that its rows exceed and the highest they have: from the
    next positive's upper limit, or just below the lowest window that needs the slot, to its
    own.  Missing positives get empty slots."""
    window = lambda j: F.get("windows", F.lit(j))
    nothing = F.lit(0).cast("bigint")
    out = []
    for j in range(k):
        above = F.greatest(window(j)["least"] - 1, window(j + 1)["most"])
        out += [F.coalesce(above, nothing), F.coalesce(window(j)["most"], nothing)]
    return F.array(*out)


def hard_negatives(table: DataFrame, anchor: Column, label: str | Column = "label", id_col: str = "vec_id",
                   vector_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   grid: int = GRID) -> DataFrame:
    """One row per anchor, positive and negative: ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``.

    ``anchor`` marks the anchors and ``label`` gives the label (a whole number), both
    from the columns of ``table``.  Entries become ``floor(grid * entry)``, a score is the
    inner product with the anchor; higher scores come first, ties by smaller id.
    Positives: the first ``positives`` rows of the anchor's label with another id.
    Negatives of a positive: the first ``negatives`` rows of another label whose score is
    at least ``low`` and at most ``high`` hundredths of the positive's.  Fewer where there
    are fewer; an anchor without positives, and a positive without negatives, gives no row.

    Rows without id, label or vector, with null or non-finite entries, or with
    another length than the commonest (of several the longest) take no part; entries are held to what keeps
    products in 64 bits.  Repeated rows are rows of their own, repeated anchors are
    answered each.  Empty tables give no rows; other columns, whatever their names, are ignored.

    Exact.  Work grows with anchors times rows; what is shuffled with the rows, plus the
    anchors once per group of ``GROUP_BYTES``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = table.sparkSession
    small_batches(spark)
    label = F.col("`" + label.replace("`", "``") + "`") if isinstance(label, str) else label
    marked = table.select(label.cast("bigint").alias("a"), F.coalesce(anchor, F.lit(False)).alias("b"), "*")
    at = lambda name: F.col(f"c{2 + table.columns.index(name)}")
    rows = numbered(marked).select(at(id_col).cast("bigint").alias("id"), F.col("c0").alias("label"),
                                   at(vector_col).cast("array<double>").alias("vector"), F.col("c1").alias("anchor"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL")
    length = common_length(rows, "vector")
    rows = rows.where(F.size("vector") == max(1, length))
    out = StructType.fromDDL(VECTORS)
    vectors = store(rows.mapInArrow(_quantise(length, grid, to_arrow_schema(out)), out)
                    .withColumn("key", F.when(F.col("anchor"), F.monotonically_increasing_id())), "negatives-vectors")
    total = vectors.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    groups = max(parallelism(spark), -(-total // GROUP_BYTES))
    anchors = vectors.where("anchor").select("id", "label", "key", "x")
    blocks = packed(vectors.select("id", "label", F.lit(0).cast("bigint").alias("key"), "x"), length)

    near = _first(_searched(_positives, blocks, packed(anchors, length), groups, length, positives, True), positives, "key")
    known = store(anchors.join(near, "key").withColumn("windows", _windows(F.col("found"), low, high)).drop("found"), "negatives-anchors")
    limited = packed(known.select("id", "label", "key", "x", _bounds(positives).alias("limits")), length, 2 * positives)
    slots = _first(_searched(_negatives, blocks, limited, groups, length, negatives, False), negatives, "key", "slot")

    # from the lowest slot up: a window takes the first of its own slot and of those below
    merged = slots.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "found"))).alias("slots"))
    each = known.join(merged, "key").select("id", "slots", F.posexplode("windows").alias("j", "window"))
    below = F.flatten(F.transform(F.filter("slots", lambda s: s["slot"] >= F.col("j")), lambda s: s["found"]))
    inside = F.slice(F.filter(below, lambda s: s["score"] >= F.col("window.least")), 1, negatives)
    return (each.select("id", "window", F.posexplode(inside).alias("at", "negative"))
            .select(F.col("id").alias("anchor_id"), F.col("window.id").alias("positive_id"), (F.col("at") + 1).alias("rank"),
                    F.col("negative.id").alias("negative_id"), F.col("window.score").alias("positive_score"),
                    F.col("negative.score").alias("negative_score")))

"""Exact deduplication by Grace hashing with complete content comparison.

1. Every input task runs its texts through an open-addressing table (linear
   probing, complete contents compared) of bounded size: one representative
   per text and table filling, so a hot text leaves a task once, not once a
   row.  Representatives and the ``row -> representative`` links are written
   to the shared folder.
2. The representatives are partitioned by hash digits into buckets.  A bucket
   whose distinct contents exceed the table's bytes is partitioned again by
   further digits, level by level, until each fits.  Sizes come from narrow
   columns; the texts themselves move once.
3. One table per bucket joins the representatives of equal texts.

Copies of one text can't be split by any digit, but they need one table entry,
and step 1 has left at most one per task and filling.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger.llm.common import arrow_bytes, keyed, parallelism, small_batches, store

#: Bytes of distinct texts that one hash table may hold.
TABLE_BYTES = 16 << 20
#: Entries that one hash table may hold.
TABLE_ROWS = 200_000
#: Finer buckets per oversized bucket.
FANOUT = 16


class OpenTable:
    """Open addressing with linear probing; entries compare complete contents."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.texts, self.nbytes = [-1] * 1024, [], [], 0

    def entry(self, text: bytes) -> tuple[int, bool]:
        """The entry of ``text`` and whether it is new."""
        slots, hashes, texts = self.slots, self.hashes, self.texts
        h = xxhash.xxh3_64_intdigest(text)
        mask = len(slots) - 1
        i = h & mask
        while (at := slots[i]) >= 0:
            if hashes[at] == h and texts[at] == text:
                return at, False
            i = (i + 1) & mask
        slots[i] = len(texts)
        hashes.append(h)
        texts.append(text)
        self.nbytes += len(text)
        if 2 * len(texts) > len(slots):
            self._grow()
        return len(texts) - 1, True

    def _grow(self) -> None:
        self.slots = slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for at, h in enumerate(self.hashes):
            i = h & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = at


def _later(a, b) -> bool:
    """Whether ``(id, row)`` b is to be kept rather than a: larger id, null
    smallest; of the same id, the earlier row."""
    if a[0] == b[0]:
        return b[1] < a[1]
    if a[0] is None or b[0] is None:
        return a[0] is None
    return b[0] > a[0]


def _combine(schema: pa.Schema, limit: int, rows: int) -> Callable[[Iterator], Iterator]:
    def run(batches):
        base = TaskContext.get().partitionId() << 36
        row = base
        table, group, best, count = OpenTable(), [], [], []

        def flush():
            signed = [h - (1 << 64) if h >= 1 << 63 else h for h in table.hashes]
            for a in range(0, len(group), 2000):
                cut = slice(a, a + 2000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(group[cut], schema.types[0]), pa.array([b[1] for b in best[cut]], schema.types[1]),
                    pa.array([b[0] for b in best[cut]], schema.types[2]), pa.array(signed[cut], schema.types[3]),
                    pa.array(count[cut], schema.types[4]), pa.array([len(t) for t in table.texts[cut]], schema.types[5]),
                    pa.array(table.texts[cut], schema.types[6])], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            mine = []
            for i, text in zip(ids, arrow_bytes(batch.column(1))):
                at, new = table.entry(text)
                if new:
                    group.append(row)
                    best.append((i, row))
                    count.append(1)
                else:
                    count[at] += 1
                    if _later(best[at], (i, row)):
                        best[at] = (i, row)
                mine.append(group[at])
                row += 1
                if table.nbytes > limit or len(group) >= rows:
                    yield from flush()
                    table, group, best, count = OpenTable(), [], [], []
            n = len(ids)
            if n:
                nulls = [pa.nulls(n, t) for t in schema.types[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(mine, schema.types[0]), pa.array(range(row - n, row), schema.types[1]),
                                                  batch.column(0), *nulls], schema=schema)
        yield from flush()

    return run


def _resolve(schema: pa.Schema) -> Callable[[Iterator], Iterator]:
    def run(batches):
        table, best, count, members = OpenTable(), [], [], []
        for batch in batches:
            groups, rows, ids, counts = (batch.column(i).to_pylist() for i in range(4))
            for g, r, i, n, text in zip(groups, rows, ids, counts, arrow_bytes(batch.column(4))):
                at, new = table.entry(text)
                if new:
                    best.append((i, r))
                    count.append(n)
                    members.append([g])
                else:
                    count[at] += n
                    members[at].append(g)
                    if _later(best[at], (i, r)):
                        best[at] = (i, r)
        flat = [(g, at) for at, gs in enumerate(members) for g in gs]
        digests = [hashlib.sha256(t).hexdigest() for t in table.texts]
        for a in range(0, len(flat), 10_000):
            part = flat[a:a + 10_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([g for g, _ in part], schema.types[0]), pa.array([best[at][0] for _, at in part], schema.types[1]),
                pa.array([best[at][1] for _, at in part], schema.types[2]), pa.array([count[at] for _, at in part], schema.types[3]),
                pa.array([digests[at] for _, at in part], schema.types[4])], schema=schema)

    return run


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha256``.

    Texts are equal when identical; null counts as empty.  The row with the
    largest id stays (a null id is the smallest); of rows that repeat an id and
    a text exactly one is ``kept``.  An empty table gives no rows; columns other
    than the two named ones are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    ddl = f"grp bigint, row bigint, id {id_type}, h bigint, n bigint, nbytes bigint, text binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    first = store(rows.mapInArrow(_combine(arrow, table_bytes, TABLE_ROWS), ddl), "exact-level0")
    members = first.where("n is null").select("grp", "row", "id")
    reps = first.where("n is not null")

    out_ddl = f"grp bigint, keep_id {id_type}, keep_row bigint, group_size bigint, sha256 string"
    out_arrow = to_arrow_schema(StructType.fromDDL(out_ddl))
    total = reps.agg(F.sum("nbytes")).first()[0] or 0
    buckets = max(parallelism(spark), -(-2 * total // table_bytes))
    levels, pending = [], reps
    while pending is not None:
        bucket = F.pmod(F.col("h"), F.lit(buckets))
        sizes = (pending.groupBy("h").agg(F.max("nbytes").alias("nbytes")).groupBy(bucket.alias("bucket"))
                 .agg(F.sum("nbytes").alias("nbytes"), F.count("*").alias("texts")))
        over = sizes.where((F.col("nbytes") > table_bytes) & (F.col("texts") > 1)).select("bucket")
        pending = pending.withColumn("bucket", bucket)
        split = not over.isEmpty()
        fits = pending.join(over, "bucket", "left_anti") if split else pending
        cols = ["grp", "row", "id", "n", "text"]
        dealt = fits.repartitionById(buckets, F.col("bucket").cast("int")) if not levels else fits.repartition(
            max(parallelism(spark), -(-2 * total // table_bytes)), "bucket")
        levels.append(dealt.select(*cols).mapInArrow(_resolve(out_arrow), out_ddl))
        pending = store(pending.join(over, "bucket", "left_semi").drop("bucket"), f"exact-level{len(levels)}") if split else None
        buckets *= FANOUT
    resolved = levels[0]
    for more in levels[1:]:
        resolved = resolved.unionByName(more)
    return members.join(resolved, "grp").select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows' ids."""
    return duplicate_groups(docs, id_col, text_col).where("kept").select(F.col("id").alias(id_col))

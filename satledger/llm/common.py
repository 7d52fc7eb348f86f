"""Shared helpers of the training-data operators: tables, scratch, Arrow views."""
from __future__ import annotations

import contextlib
import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satledger.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker: bounds what texts of any
#: length take there and in the executor's own buffers.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` where the session allows larger ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs its own tasks only, and a value
    drawn once (row numbers, range bounds) never changes on a retry."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _record is not None:
        _record.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_record: list[str] | None = None


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Add the path of every table that :func:`store` writes to ``paths``."""
    global _record
    before, _record = _record, paths
    try:
        yield
    finally:
        _record = before


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more: it does
    so once the driver has collected its garbage, which may take long to happen."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables written by :func:`store` that no later plan reads."""
    for df in frames:
        remove(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``id, text`` (and ``more`` as ``c0, c1, ...``) only: other columns, whatever
    their names, cannot clash with the operator's own."""
    cols = [place(docs, id_col).alias("id"), place(docs, text_col).alias("text")]
    return numbered(docs).select(*cols, *(place(docs, c).alias(f"c{i}") for i, c in enumerate(more)))


def with_text(docs: DataFrame, text_col: str | None = None) -> DataFrame:
    """``doc``, a struct of the columns of ``docs`` in order, and apart from it ``text``, the
    column ``text_col`` where one is named."""
    fields = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != text_col]
    return numbered(docs).select(F.struct(*fields).alias("doc"), *([place(docs, text_col).alias("text")] if text_col else []))


def as_before(rows: DataFrame, columns: list[str], text_col: str | None = None) -> DataFrame:
    """The rows of :func:`with_text` as a table of ``columns``, by position."""
    flat = rows.select("doc.*", *(["text"] if text_col else []))
    found = [c for c in columns if c != text_col] + ([text_col] if text_col else [])
    at = {c: i for i, c in enumerate(found)}
    return numbered(flat).select(*(f"c{at[c]}" for c in columns)).toDF(*columns)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``c0, c1, ...`` by position, whatever their names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> Column:
    """The column of ``numbered(df)`` that ``df`` calls ``name``."""
    return F.col(f"c{df.columns.index(name)}")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Total UTF-8 bytes of a text column."""
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0


#: Partitions that a shuffle is dealt to at most, whatever the bytes.
MOST_PARTITIONS = 1 << 17


def spread(df: DataFrame, nbytes: int, target: int = 32 << 20) -> int:
    """Partitions so that each holds about ``target`` bytes, more where these would be over ``MOST_PARTITIONS``."""
    return max(parallelism(df.sparkSession), min(MOST_PARTITIONS, -(-nbytes // target)))


def arrow_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and its ``n + 1`` offsets; null = empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def arrow_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null = empty."""
    raw, at = arrow_text(column)
    data = raw.tobytes() if len(column) else b""
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

"""The invoice store - versioned Parquet partitions behind a manifest.

``data`` holds the rows by source and UTC day, ``keys`` the index ``(source,
identifier) -> day`` and ``contents`` the index ``content_id -> (source, day)``, both by
hash bucket, ``gone`` the retracted keys by source.  Each lies in
``<table>/v=<version>/<partition>``.  A commit writes new versions beside the old
ones and then adds ``manifest/N.json``, which names the versions that make up each
partition: a reader sees all of a commit or nothing, and a crash leaves only files
that no manifest names.  The manifest has one entry per partition: metadata.

* A version's name is its writer's own, and a manifest is never overwritten: of two
  writers the second finds the number taken and starts again from the new manifest.
* The indexes grow by what a batch changes: a version holds the changed entries,
  and the newest entry of a key wins.  New keys add a version to their day.
* A partition of more than ``MOST_VERSIONS`` versions is folded by the commit that
  adds to it: from the newest one back as long as the next is at most twice as large
  as those taken, so that a row is written again a logarithmic number of times.

Rows without an event time live in day ``none``.  ``read_store`` takes a range of
days, and ``prune_days`` turns an event-time bound into a partition predicate, so a report over two weeks opens
two weeks of files; within a partition files are sorted by ``creation_date``."""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satledger.functions.columns import epoch_to_ntz
from satledger.schemas import INVOICES, KEY
from satledger.session import cut_lineage, read_json, write_json

def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
STORE = T.StructType(INVOICES.fields + [T.StructField("day", T.StringType(), True)])
SCHEMAS = {
    "data": STORE,
    # day: null once the key has left the store
    "keys": _schema(identifier=_S, day=_S, source=_S, bucket=_I),
    # first, last: event times of the id's rows of the day (null: no row, or none with a time);
    # whole: of all of them, else of rows added to those known before
    "contents": _schema(content_id=_S, source=_S, day=_S, first=_L, last=_L, whole=T.BooleanType(), bucket=_I),
    "gone": _schema(identifier=_S, source=_S),
}
PARTITIONS = {"data": ["source", "day"], "keys": ["source", "bucket"], "contents": ["bucket"], "gone": ["source"]}
ORDER = {"data": "creation_date", "keys": "identifier", "contents": "content_id", "gone": "identifier"}
NO_DAY = "none"
BUCKETS = 16
#: Epoch seconds that have a calendar day (years 1 to 9999).
EPOCHS = (-62135596800, 253402300799)
#: Manifests whose files are kept for readers that still use them.
KEPT = 3
#: Versions of a partition before some are folded into one.
MOST_VERSIONS = 8
#: Attempts of a commit that other writers get ahead of.
ATTEMPTS = 20
#: Bytes of a day's files that one task writes again after a deletion.
SLICE_BYTES = 16 << 20


class Conflict(RuntimeError):
    """Another writer has committed the same manifest number."""


def day_of(c="creation_date") -> Column:
    """UTC day of an epoch column, ``yyyy-MM-dd``; ``none`` without a valid time."""
    col = F.col(c) if isinstance(c, str) else c
    valid = F.when(col.between(*EPOCHS), col)
    return F.coalesce(F.date_format(epoch_to_ntz(valid), "yyyy-MM-dd"), F.lit(NO_DAY))


def day_literal(epoch: int) -> Column:
    return day_of(F.lit(epoch).cast("bigint"))


def bucket_of(c="identifier") -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def packed(c="content_id") -> Column:
    """A content id as bytes: a SHA-256 in hex takes half the room, other texts are kept
    behind the length of one.  Equal only for equal ids."""
    col = F.col(c)
    return F.when(col.rlike(r"^[0-9a-f]{64}\z"), F.unhex(col)).otherwise(F.concat(col.cast("binary"), F.lit(bytearray(33))))


def unpacked(c="content_id") -> Column:
    col = F.col(c)
    return F.when(F.length(col) == 32, F.lower(F.hex(col))).otherwise(col.substr(F.lit(1), F.length(col) - 33).cast("string"))


def prune_days(df: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Add partition predicates implied by ``since < creation_date`` and
    ``creation_date <= until`` when ``df`` carries the store's ``day``: rows that
    these drop, the bounds themselves drop too."""
    if "day" not in df.columns:
        return df
    cond = F.lit(True)
    if since is not None:
        cond = cond & (F.col("day") >= day_literal(since))
    if until is not None:
        cond = cond & (F.col("day") <= day_literal(until))
    return df.filter(cond)


# --- manifest ------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, Path = _fs(spark, path)
    folder = Path(f"{path}/manifest")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if re.fullmatch(r"\d+\.json", s.getPath().getName()))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """``{"version": N, "replaced": M, "data": {partition: [[version, bytes], ...]}, "keys": {..}, ...}``,
    oldest version first; a partition is its path below the version, M the last commit that
    replaced the whole store."""
    if version is None:
        known = _versions(spark, path)
        if not known:
            return {"version": 0, "replaced": 0, **{t: {} for t in PARTITIONS}}
        version = known[-1]
    return read_json(spark, f"{path}/manifest/{version}.json")


def _partition(table: str, *values) -> str:
    """The path of a partition as Spark's writer names it."""
    escape = lambda v: re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", str(v))
    return "/".join(f"{c}={escape(v)}" for c, v in zip(PARTITIONS[table], values))


def _read(spark: SparkSession, path: str, table: str, state: dict, only: Iterable[str] | None = None, turn: bool = False) -> DataFrame:
    """Rows of the named partitions (all by default); ``turn``: with the number of the commit that wrote them."""
    names = state[table] if only is None else [p for p in only if p in state[table]]
    return _rows(spark, path, table, [f"{path}/{table}/v={v}/{p}" for p in names for v, _ in state[table][p]], turn)


def _rows(spark: SparkSession, path: str, table: str, files: list[str], turn: bool = False) -> DataFrame:
    schema, more = SCHEMAS[table], [F.split("v", "-")[0].cast("int").alias("turn")] if turn else []
    if not files:
        return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("turn", T.IntegerType())] * turn))
    return (spark.read.schema(T.StructType(schema.fields + [T.StructField("v", T.StringType())]))
            .option("basePath", f"{path}/{table}").parquet(*files).select(*schema.fieldNames(), *more))


def _new_version(state: dict) -> str:
    return f"{state['version'] + 1:08d}-{uuid.uuid4().hex[:12]}"


def _write(df: DataFrame, path: str, table: str, version: str, dealt: bool = False) -> dict[str, int]:
    """Write one version of a table; its partitions with their bytes.  Content ids may come
    packed.  ``dealt``: the rows already lie by partition."""
    spark = df.sparkSession
    target = f"{path}/{table}/v={version}"
    rows = df.select(*SCHEMAS[table].fieldNames())
    ids = "content_id" in rows.columns
    if ids and dict(rows.dtypes)["content_id"] == "string" and not dealt:
        rows = rows.withColumn("content_id", packed())
    if not dealt:
        # ``rebalance`` lets AQE split a hot partition over several tasks
        rows = rows.hint("rebalance", *PARTITIONS[table])
    if ids and dict(rows.dtypes)["content_id"] == "binary":
        rows = rows.withColumn("content_id", unpacked())
    # zstd: hex digits take half a byte
    (rows.sortWithinPartitions(ORDER[table]).write.option("compression", "zstd").option("partitionOverwriteMode", "static")
     .partitionBy(*PARTITIONS[table]).parquet(target))
    fs, Path = _fs(spark, path)
    out: dict[str, int] = {}
    files = fs.listFiles(Path(target), True)
    while files.hasNext():
        file = files.next()
        name = file.getPath().toString()
        if name.endswith(".parquet"):
            p = name.split(f"/v={version}/", 1)[1].rsplit("/", 1)[0]
            out[p] = out.get(p, 0) + file.getLen()
    return out


def _last_day(entries: DataFrame) -> DataFrame:
    """The newest entry of each key."""
    return entries.groupBy(*KEY).agg(F.max_by("day", "turn").alias("day"))


CONTENT = ["content_id", "source", "day"]


def _content_days(entries: DataFrame) -> DataFrame:
    """One entry per content id, source and day: its newest whole one and what was added since.
    A version has one entry of each, so these groups have a row per version at most."""
    since = F.max(F.when(F.col("whole"), F.col("turn"))).over(Window.partitionBy(*CONTENT))
    live = entries.withColumn("since", since).filter(F.col("since").isNull() | (F.col("turn") >= F.col("since")))
    return live.groupBy(*CONTENT).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("since").isNotNull().alias("whole"))


FOLDED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "data": lambda rows: rows,  # a key is in one version only
    "keys": lambda rows: _last_day(rows).withColumn("bucket", bucket_of()),
    "contents": lambda rows: _content_days(rows).withColumn("bucket", bucket_of("content_id")),
    "gone": lambda rows: rows.select("identifier", "source").distinct(),
}


def _surplus(versions: list) -> int:
    """How many of the newest versions to fold: as long as the next is at most twice as large as these."""
    n, total = 1, versions[-1][1]
    while n < len(versions) and (n == 1 or versions[-n - 1][1] <= 2 * total):
        n += 1
        total += versions[-n][1]
    return n


def _fold(spark: SparkSession, path: str, state: dict, version: str) -> None:
    """Fold partitions of too many versions of ``state``, the manifest to be."""
    for table in PARTITIONS:
        long = {p: _surplus(vs) for p, vs in state[table].items() if len(vs) > MOST_VERSIONS}
        if long:
            part = {table: {p: state[table][p][-n:] for p, n in long.items()}}
            written = _write(FOLDED[table](_read(spark, path, table, part, turn=True)), path, table, version + "f")
            for p, n in long.items():
                state[table][p][-n:] = [[version + "f", written[p]]] if p in written else []


def _commit(spark: SparkSession, path: str, state: dict, version: str, changes: dict[str, tuple[Iterable[str], dict[str, int]]]) -> None:
    """Switch to a manifest with ``changes``: per table the partitions that were
    rewritten as a whole and those that the new version holds, with their bytes."""
    number = state["version"] + 1
    new = {"version": number, "replaced": number if changes.get("replaced") else state["replaced"]}
    for table in PARTITIONS:
        replaced, written = changes.get(table, ((), {}))
        entries = {p: list(v) for p, v in state.get(table, {}).items() if p not in set(replaced)}
        for p, size in written.items():
            entries[p] = entries.get(p, []) + [[version, size]]
        new[table] = entries
    _fold(spark, path, new, version)
    try:
        write_json(spark, f"{path}/manifest/{number}.json", new, overwrite=False)
    except Exception as e:
        if number not in _versions(spark, path):
            raise
        _drop(spark, path, version)
        raise Conflict(f"another writer has committed version {number} of {path}") from e
    vacuum(spark, path)


def _drop(spark: SparkSession, path: str, version: str) -> None:
    """Delete the files of a version that no manifest names."""
    fs, Path = _fs(spark, path)
    for table in PARTITIONS:
        for name in (version, version + "f"):
            fs.delete(Path(f"{path}/{table}/v={name}"), True)


def _committed(spark: SparkSession, path: str, change: Callable[[dict, str], dict | None]) -> None:
    """Commit what ``change(manifest, version)`` writes, if anything; again, from the
    manifest of then, where another writer was faster."""
    for attempt in range(ATTEMPTS):
        state = manifest(spark, path)
        version = _new_version(state)
        try:
            changes = change(state, version)
            return None if changes is None else _commit(spark, path, state, version, changes)
        except Exception:
            # also a file that is gone because the other writer's commit let it go
            if attempt == ATTEMPTS - 1 or manifest(spark, path)["version"] == state["version"]:
                raise
            _drop(spark, path, version)


def vacuum(spark: SparkSession, path: str, keep: int = KEPT) -> None:
    """Delete what none of the last ``keep`` manifests names, also what crashed writers
    left: a version numbered below these manifests can't be committed any more."""
    known = _versions(spark, path)
    if len(known) <= keep:
        return
    fs, Path = _fs(spark, path)
    live: dict[str, dict[str, set]] = {t: {} for t in PARTITIONS}
    for n in known[-keep:]:
        state = manifest(spark, path, n)
        for t in PARTITIONS:
            for p, vs in state[t].items():
                for v, _ in vs:
                    live[t].setdefault(v, set()).add(p)
    dropped: dict[str, dict[str, set]] = {t: {} for t in PARTITIONS}
    for n in known[:-keep]:
        state = manifest(spark, path, n)
        for t in PARTITIONS:
            for p, vs in state[t].items():
                for v, _ in vs:
                    dropped[t].setdefault(v, set()).add(p)
    for t in PARTITIONS:
        folder = Path(f"{path}/{t}")
        for s in fs.listStatus(folder) if fs.exists(folder) else ():
            v = s.getPath().getName()[2:]
            if v not in live[t] and int(v.split("-")[0]) <= known[-keep]:
                fs.delete(s.getPath(), True)
        for v, names in dropped[t].items():
            for p in names - live[t].get(v, names):
                fs.delete(Path(f"{path}/{t}/v={v}/{p}"), True)
    for n in known[:-keep]:
        fs.delete(Path(f"{path}/manifest/{n}.json"), False)


# --- readers and writers -----------------------------------------------------------

def _days(state: dict, since: int | None, until: int | None) -> list[str] | None:
    """Partitions of ``data`` that may hold ``since < creation_date <= until``."""
    if since is None and until is None:
        return None
    import datetime

    day = lambda e: (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=min(max(e, EPOCHS[0]), EPOCHS[1]))).strftime("%Y-%m-%d").zfill(10)
    low, high = "" if since is None else day(since), "~" if until is None else day(until)
    return [p for p in state["data"] if low <= p.rsplit("day=", 1)[1] <= high]


def read_store(spark: SparkSession, path: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """The store's current rows; empty where nothing has been committed.  With a
    range only the days of ``since < creation_date <= until`` are listed and read: whole
    days, as by :func:`prune_days`."""
    state = manifest(spark, path)
    return _read(spark, path, "data", state, _days(state, since, until))


def retracted(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """Keys that were deleted: they stay out, whatever loads them again."""
    return _read(spark, path, "gone", state or manifest(spark, path)).select(*KEY).distinct()


def _ids(rows: DataFrame) -> DataFrame:
    """Content id (packed), source and day of rows that have one."""
    return rows.filter(F.col("content_id").isNotNull()).withColumn("content_id", packed()).select(*CONTENT)


def _contents(rows: DataFrame, whole: Column, touched: DataFrame | None = None) -> DataFrame:
    """Entries by content id (packed), source and day of ``rows``; with ``touched`` (as by
    :func:`_ids`) only those that it names, also where no row is left."""
    timed = F.when(F.col("day") != NO_DAY, F.col("creation_date"))  # other times lie in no window
    out = (rows.filter(F.col("content_id").isNotNull()).withColumn("content_id", packed()).groupBy(*CONTENT)
           .agg(F.min(timed).alias("first"), F.max(timed).alias("last")))
    if touched is not None:
        out = touched.distinct().join(out, CONTENT, "left")
    return out.withColumn("whole", whole).withColumn("bucket", bucket_of(unpacked()))


def write_store(df: DataFrame, path: str) -> None:
    """Replace the whole store with ``df`` (one row per key), retracted keys included."""
    spark = df.sparkSession
    rows = df.withColumn("day", day_of()).select(*STORE.fieldNames())

    def change(state, version):
        data = _write(rows, path, "data", version)
        written = _rows(spark, path, "data", [f"{path}/data/v={version}"] if data else [])
        keys = _write(written.select("identifier", "day", "source", bucket_of().alias("bucket")), path, "keys", version)
        contents = _write(_contents(written, F.lit(True)), path, "contents", version)
        return {"replaced": True, "data": (state["data"], data), "keys": (state["keys"], keys),
                "contents": (state["contents"], contents), "gone": (state["gone"], {})}

    _committed(spark, path, change)


def _held(spark: SparkSession, path: str, state: dict, keys: DataFrame) -> DataFrame:
    """``keys`` (source, identifier and more) with the day that holds their row, null without one."""
    if not state["keys"]:
        return cut_lineage(keys.withColumn("old_day", F.lit(None).cast("string")))
    spots = keys.select("source", bucket_of().alias("bucket")).distinct().collect()  # at most sources x buckets
    index = _read(spark, path, "keys", state, [_partition("keys", r["source"], r["bucket"]) for r in spots], turn=True)
    known = _last_day(index.join(keys, KEY, "left_semi"))
    return cut_lineage(keys.join(known, KEY, "left").withColumnRenamed("day", "old_day"))


def _write_indexes(path: str, version: str, keys: DataFrame, contents: DataFrame) -> dict:
    """New entries of both indexes, written side by side."""
    with ThreadPoolExecutor(2) as pool:
        tables = {"keys": keys, "contents": contents}
        jobs = {t: pool.submit(inheritable_thread_target(keys.sparkSession)(_write), df, path, t, version) for t, df in tables.items()}
        return {t: ((), job.result()) for t, job in jobs.items()}


def _digest() -> Column:
    """Tells whether two rows are equal in every field."""
    values = [F.unix_micros(n) if n == "created_at" else F.col(n) for n in INVOICES.fieldNames()]
    text = F.to_json(F.struct(*[v.alias(n) for v, n in zip(values, INVOICES.fieldNames())]), {"ignoreNullFields": "false"})
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _spots(held: DataFrame) -> list:
    """The days that hold rows of ``held`` keys."""
    return held.filter("old_day IS NOT NULL").select("source", "old_day").distinct().collect()  # at most sources x days


def _days_of(spots: list) -> list[str]:
    return [_partition("data", r["source"], r["old_day"]) for r in spots]


def _apply(spark: SparkSession, path: str, state: dict, version: str, held: DataFrame, changed: Callable[[DataFrame | None], DataFrame],
           dealt: bool = False) -> dict:
    """Write the days of ``held`` keys with ``changed(their rows)`` (None without any), and the
    index entries of these keys and of their content ids, before and after."""
    spots = _spots(held)
    days = _days_of(spots)
    before = _read(spark, path, "data", state, days)
    data = _write(changed(before if days else None), path, "data", version, dealt)
    after = _rows(spark, path, "data", [f"{path}/data/v={version}"] if data else [])

    entry = lambda rows: rows.select("identifier", "day", "source", bucket_of().alias("bucket"))
    if not days:  # new keys only: what was written is the batch
        return {"data": ((), data), **_write_indexes(path, version, entry(after), _contents(after, F.lit(False)))}
    now = held.join(after.select(*KEY, "day"), KEY, "left")
    keys = entry(now.filter(~F.col("day").eqNullSafe(F.col("old_day"))))

    # content ids of these keys as they were and as they are, with all rows of their days
    mine = held.select(*KEY)
    touched = _ids(before.join(mine, KEY, "left_semi")).unionByName(_ids(after.join(mine, KEY, "left_semi")))
    read = F.concat_ws("\n", "source", "day").isin([f"{r['source']}\n{r['old_day']}" for r in spots])
    return {"data": (days, data), **_write_indexes(path, version, keys, _contents(after, read, touched))}


def _to_merge(spark: SparkSession, path: str, state: dict, rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """What of ``rows`` changes the store, and the days that hold these keys; None if
    nothing does.  A row that is stored as it is, is left out, and so are retracted keys:
    what is loaded again costs a look at its keys, not a new copy of its days."""
    if not state["keys"] and not state["gone"]:
        return rows, rows.select(*KEY, F.lit(None).cast("string").alias("old_day"))
    keys = rows.select(*KEY, _digest().alias("digest")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest"))
    held = _held(spark, path, state, keys)
    left = held
    if state["gone"]:
        left = left.join(retracted(spark, path, state), KEY, "left_anti")
    days = _days_of(_spots(held))
    if days:
        stored = _read(spark, path, "data", state, days).select(*KEY, _digest().alias("was"))
        same = held.filter("n = 1 AND old_day IS NOT NULL").join(stored, KEY).groupBy(*KEY).agg(F.min(F.col("was") == F.col("digest")).alias("same"))
        left = left.join(same.filter("same"), KEY, "left_anti")
    if left is held:  # new keys only
        return rows, held
    left = cut_lineage(left)
    total, some = held.count(), left.count()
    if not some:
        return None
    if some < total:
        mine = left.select(*[F.col(c).alias(f"_left_{c}") for c in KEY])
        rows = rows.join(mine, rows["source"].eqNullSafe(F.col("_left_source")) & rows["identifier"].eqNullSafe(F.col("_left_identifier")), "left_semi")
    return rows, left


def merge_rows(newest: DataFrame, path: str) -> None:
    """Attribute-level merge of ``newest`` (one row per key) into the store.

    The index names the days that hold rows of these keys: only those partitions are
    read, and of these only those with a row that changes are rewritten.  A row whose
    event day changes moves; new keys are added to their day as a further version,
    without reading it.  Retracted keys stay out.  ``newest`` is read several times."""
    from satledger.operators.merge import coalesced

    spark = newest.sparkSession
    cols = INVOICES.fieldNames()

    def change(state, version):
        found = _to_merge(spark, path, state, newest.select(*cols))
        if found is None:
            return None
        rows, held = found
        merged = lambda old: rows if old is None else coalesced(old.select(*cols), rows, KEY)
        return _apply(spark, path, state, version, held, lambda old: merged(old).withColumn("day", day_of()))

    _committed(spark, path, change)


def _without(rows: DataFrame, dropped: DataFrame, state: dict) -> DataFrame:
    """``rows`` of whole days without those of the keys ``dropped`` (source, identifier,
    old_day), dealt by day and, for a large day, by slices of its keys."""
    sizes = {p: sum(size for _, size in vs) for p, vs in state["data"].items()}
    spots = _spots(dropped)
    slices = [(f"{r['source']}\n{r['old_day']}", -(-sizes.get(p, 0) // SLICE_BYTES)) for r, p in zip(spots, _days_of(spots))]
    large = [F.lit(v) for pair in slices if pair[1] > 1 for v in pair]
    n = F.coalesce(F.try_element_at(F.create_map(*large), F.concat_ws("\n", "source", "day")), F.lit(1)) if large else F.lit(1)
    marks = dropped.select(*KEY, F.col("old_day").alias("day"), F.lit(True).alias("_drop"))
    both = rows.withColumn("content_id", packed()).withColumn("_drop", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_slice", F.pmod(F.xxhash64("identifier"), n)).repartition("source", "day", "_slice")
    hit = F.max("_drop").over(Window.partitionBy("source", "day", "_slice", "identifier"))
    return both.withColumn("_hit", hit).filter("NOT _hit").select(*rows.columns)


def delete_rows(keys: DataFrame, path: str) -> None:
    """Retract the rows of ``keys`` (source, identifier), now and whenever they are
    loaded again; only the partitions that hold them are rewritten."""
    spark = keys.sparkSession
    keys = cut_lineage(keys.select(*KEY).distinct())
    fresh = lambda state: keys.join(retracted(spark, path, state), KEY, "left_anti") if state["gone"] else keys

    def change(state, version):
        held = _held(spark, path, state, keys)
        held = held.filter("old_day IS NOT NULL")
        if not _spots(held):
            return {"gone": ((), _write(fresh(state), path, "gone", version))}
        out = _apply(spark, path, state, version, held, lambda old: _without(old, held, state), dealt=True)
        return {**out, "gone": ((), _write(fresh(state), path, "gone", version))}

    _committed(spark, path, change)


# --- content ids ---------------------------------------------------------------------

def changed_content_ids(spark: SparkSession, path: str, seen: dict | None) -> DataFrame:
    """Content ids whose entries changed since the manifest ``seen``, maybe several times; all
    ids without one, or where the store has been replaced since."""
    state = manifest(spark, path)
    known = seen["contents"] if seen and seen["replaced"] == state["replaced"] else {}
    new = {p: [v for v in vs if v not in known.get(p, [])] for p, vs in state["contents"].items()}
    return _read(spark, path, "contents", {"contents": new}).select("content_id")


def packed_content_days(spark: SparkSession, path: str, ids: DataFrame | None) -> DataFrame:
    """:func:`content_days` of packed ``ids``, packed; without ``ids`` of all."""
    state = manifest(spark, path)
    only = None
    if ids is not None:
        spots = ids.select(bucket_of(unpacked()).alias("bucket")).distinct().collect()  # at most the buckets
        only = [_partition("contents", r["bucket"]) for r in spots]
    entries = _read(spark, path, "contents", state, only, turn=True).withColumn("content_id", packed())
    if ids is not None:
        entries = entries.join(ids, "content_id", "left_semi")
    if any(len(vs) > 1 for vs in state["contents"].values()):
        entries = _content_days(entries)
    return entries.filter(F.col("first").isNotNull() | (F.col("day") == NO_DAY)).select(*CONTENT, "first", "last")


def content_days(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """``content_id, source, day, first, last`` of the days that hold rows of ``ids``."""
    found = packed_content_days(spark, path, ids.filter(F.col("content_id").isNotNull()).withColumn("content_id", packed()))
    return found.withColumn("content_id", unpacked())


def rows_of_days(spark: SparkSession, path: str, days: Iterable[tuple[str, str]]) -> DataFrame:
    """Rows of the named (source, day) partitions."""
    return _read(spark, path, "data", manifest(spark, path), [_partition("data", *d) for d in days])

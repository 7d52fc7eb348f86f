"""The partitioned store: day pruning reaches the scan, results unchanged."""
import pytest
from pyspark.sql import functions as F

import satledger.sources.store as store_module
from conftest import SF0001
from satledger.plans import params as P
from satledger.operators import report
from satledger.session import scratch_path
from satledger.sources.adapter import load_invoices
from satledger.schemas import INVOICES
from satledger.sources.store import manifest, read_store, write_store
from satledger.streaming.ingest import merge_into_store


def test_report_on_store_prunes_days(spark):
    inv = load_invoices(spark, SF0001)
    path = scratch_path(spark, "store")
    write_store(inv, path)
    store = read_store(spark, path)
    since = 1705363200
    a = report.boost_report(inv, P.SHOWS["Alpha"], since, ["user_5"])
    b = report.boost_report(store, P.SHOWS["Alpha"], since, ["user_5"])
    assert sorted(map(tuple, a["senders"].collect())) == sorted(map(tuple, b["senders"].collect()))
    assert a["summary"].first() == b["summary"].first()
    plan = b["senders"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-16" in plan


def frame(spark, rows):
    """Rows of (source, identifier, creation_date, message, app_name, seq)."""
    schema = "source string, identifier string, creation_date bigint, message string, app_name string, seq bigint"
    df = spark.createDataFrame(rows, schema)
    typed = {f.name: f.dataType for f in INVOICES.fields}
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in typed.items()], "seq")


DAY = 86400
BATCHES = [
    [("a", "1", 10 * DAY, "m1", "x", 1), ("a", "2", None, "no time", None, 2), ("a", "3", 10 * DAY, "v1", "y", 4),
     ("a", "3", 10 * DAY, "v2", None, 5), ("b", "1", 11 * DAY, "other source", None, 3)],
    [("a", "9", None, "also none", None, 6), ("a", "1", 12 * DAY, None, "moved", 7), ("a", "4", 10 * DAY, "new key", None, 8)],
    [("a", "2", 13 * DAY, None, "got a time", 9), ("a", "3", None, "v3", None, 10), ("a", "5", 9_999_999_999_999_999, "far", None, 11)],
]
WANT = [("a", "1", 12 * DAY, "m1", "moved", "1970-01-13"), ("a", "2", 13 * DAY, "no time", "got a time", "1970-01-14"),
        ("a", "3", 10 * DAY, "v3", "y", "1970-01-11"), ("a", "4", 10 * DAY, "new key", None, "1970-01-11"),
        ("a", "5", 9_999_999_999_999_999, "far", None, "none"), ("a", "9", None, "also none", None, "none"),
        ("b", "1", 11 * DAY, "other source", None, "1970-01-12")]
COLS = ["source", "identifier", "creation_date", "message", "app_name", "day"]


def rows_of(spark, path):
    return sorted((tuple(r) for r in read_store(spark, path).select(*COLS).collect()), key=lambda r: r[:2])


def test_merge_is_lossless(spark):
    """Null days, moved days, versions in a batch in any order, replays."""
    for flip in (False, True):
        path = scratch_path(spark, "store")
        for batch in BATCHES:
            for _ in range(2):  # a replayed batch changes nothing
                merge_into_store(frame(spark, batch[::-1] if flip else batch).repartition(3), path, "seq")
        assert rows_of(spark, path) == WANT


def test_merge_reads_only_the_days_of_its_keys(spark):
    path = scratch_path(spark, "store")
    for batch in BATCHES:
        merge_into_store(frame(spark, batch), path, "seq")
    before = manifest(spark, path)
    merge_into_store(frame(spark, [("b", "1", 11 * DAY, "changed", None, 20), ("a", "77", 10 * DAY, "added", None, 21)]), path, "seq")
    after = manifest(spark, path)
    numbers = lambda state, p: [int(v.split("-")[0]) for v, _ in state["data"][p]]
    assert numbers(after, "source=b/day=1970-01-12") == [after["version"]]
    assert numbers(after, "source=a/day=1970-01-11") == numbers(before, "source=a/day=1970-01-11") + [after["version"]]
    assert {p for p in after["data"] if after["data"][p] != before["data"].get(p)} == {"source=b/day=1970-01-12", "source=a/day=1970-01-11"}


def test_delete_and_crash_before_the_switch(spark, monkeypatch):
    path = scratch_path(spark, "store")
    for batch in BATCHES:
        merge_into_store(frame(spark, batch), path, "seq")
    monkeypatch.setattr(store_module, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        merge_into_store(frame(spark, [("a", "1", 1, "lost", None, 30)]), path, "seq")
    monkeypatch.undo()
    assert rows_of(spark, path) == WANT
    store_module.delete_rows(spark.createDataFrame([("a", "9"), ("b", "1"), ("a", "unknown")], "source string, identifier string"), path)
    assert rows_of(spark, path) == [r for r in WANT if r[:2] not in (("a", "9"), ("b", "1"))]
    assert "source=b/day=1970-01-12" not in manifest(spark, path)["data"]


def test_vacuum_keeps_what_recent_manifests_name(spark):
    path = scratch_path(spark, "store")
    for i in range(store_module.KEPT + 3):
        merge_into_store(frame(spark, [("a", "1", 10 * DAY, f"m{i}", None, i)]), path, "seq")
    assert [r[3] for r in rows_of(spark, path)] == [f"m{store_module.KEPT + 2}"]
    versions = store_module._versions(spark, path)
    assert len(versions) == store_module.KEPT
    found = spark.read.parquet(f"{path}/data").select("v").distinct().collect()
    assert {int(r["v"].split("-")[0]) for r in found} <= set(versions)


# writers, index, folding ----------------------------------------------------------

def test_two_writers_lose_nothing(spark, monkeypatch):
    """B commits while A, which read the manifest before, is about to: A starts again."""
    path = scratch_path(spark, "store")
    merge_into_store(frame(spark, [("a", "1", 10 * DAY, "base", None, 1)]), path, "seq")
    commit, turns = store_module._commit, []

    def late(*args):
        turns.append(args[2]["version"])
        if len(turns) == 1:
            merge_into_store(frame(spark, [("a", "2", 10 * DAY, "B", None, 3), ("a", "1", None, "B", None, 3)]), path, "seq")
        return commit(*args)

    monkeypatch.setattr(store_module, "_commit", late)
    merge_into_store(frame(spark, [("a", "3", 10 * DAY, "A", None, 2), ("a", "1", None, None, "A", 2)]), path, "seq")
    monkeypatch.undo()
    assert turns == [1, 1, 2]
    assert [r[:5] for r in rows_of(spark, path)] == [("a", "1", 10 * DAY, "B", "A"), ("a", "2", 10 * DAY, "B", None), ("a", "3", 10 * DAY, "A", None)]
    state = manifest(spark, path)
    named = {v for t in store_module.PARTITIONS for vs in state[t].values() for v, _ in vs}
    found = {r["v"] for r in spark.read.parquet(f"{path}/data").select("v").distinct().collect()}
    assert state["version"] == 3 and found <= {v for n in (1, 2, 3) for vs in manifest(spark, path, n)["data"].values() for v, _ in vs} | named


def test_a_manifest_is_never_overwritten(spark):
    path = scratch_path(spark, "store")
    merge_into_store(frame(spark, [("a", "1", 10 * DAY, "first", None, 1)]), path, "seq")
    stale = {"version": 0, "replaced": 0, **{t: {} for t in store_module.PARTITIONS}}
    with pytest.raises(store_module.Conflict):
        store_module._commit(spark, path, stale, store_module._new_version(stale), {})
    assert [r[3] for r in rows_of(spark, path)] == ["first"]


def many(spark, first, n, source="a"):
    """``n`` payments, 100,000 a day, from number ``first`` on."""
    ids = spark.range(first, first + n)
    cols = {"source": F.lit(source), "identifier": F.col("id").cast("string"), "creation_date": (F.col("id") / 100_000).cast("bigint") * DAY,
            "content_id": F.sha2(F.col("id").cast("string"), 256)}
    return ids.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INVOICES.fields])


def index_rows(spark, path, version):
    state = manifest(spark, path)
    return {t: sum(1 for _ in store_module._read(spark, path, t, {t: {p: [x for x in vs if x[0].startswith(f"{version:08d}")]
                   for p, vs in state[t].items()}}).toLocalIterator()) for t in ("keys", "contents")}


def test_index_grows_by_the_batch(spark):
    """On a store of a million keys 1,000 new ones write 1,000 index entries."""
    path = scratch_path(spark, "store")
    write_store(many(spark, 0, 1_000_000), path)
    merge_into_store(many(spark, 1_000_000, 1000), path)
    assert index_rows(spark, path, 2) == {"keys": 1000, "contents": 1000}
    # changed rows that stay in their day and keep their content write no key entry
    merge_into_store(many(spark, 1_000_000, 1000).withColumn("memo", F.lit("x")), path)
    assert index_rows(spark, path, 3) == {"keys": 0, "contents": 1000}
    assert read_store(spark, path).count() == 1_001_000


def test_versions_stay_bounded(spark, monkeypatch):
    """Batch after batch into the same day: versions, files and manifests stay few."""
    monkeypatch.setattr(store_module, "MOST_VERSIONS", 3)
    path = scratch_path(spark, "store")
    for i in range(9):
        merge_into_store(frame(spark, [("a", str(i), 10 * DAY + i, f"m{i}", None, i), ("a", str(1000 + i), 11 * DAY, None, None, i)]), path, "seq")
        state = manifest(spark, path)
        assert max(len(vs) for t in store_module.PARTITIONS for vs in state[t].values()) <= store_module.MOST_VERSIONS
    assert read_store(spark, path).count() == 18 == read_store(spark, path).select("identifier").distinct().count()
    fs, Path = store_module._fs(spark, path)
    files, kept = fs.listFiles(Path(f"{path}/data"), True), 0
    while files.hasNext():
        kept += files.next().getPath().getName().endswith(".parquet")
    assert kept <= 2 * (store_module.MOST_VERSIONS + 2 * store_module.KEPT)
    merge_into_store(frame(spark, [("a", "7", 12 * DAY, "moved", None, 99)]), path, "seq")
    assert read_store(spark, path, since=12 * DAY).select("identifier").collect() == [("7",)]
    assert len(read_store(spark, path, until=10 * DAY + 5).inputFiles()) < len(read_store(spark, path).inputFiles())


def test_retracted_rows_stay_out(spark):
    path = scratch_path(spark, "store")
    for batch in BATCHES:
        merge_into_store(frame(spark, batch), path, "seq")
    gone = spark.createDataFrame([("a", "3"), ("b", "1"), ("c", "not there yet")], "source string, identifier string")
    store_module.delete_rows(gone, path)
    for batch in (*BATCHES, [("c", "not there yet", DAY, "late", None, 50), ("c", "other", DAY, "kept", None, 51)]):
        merge_into_store(frame(spark, batch), path, "seq")
    keys = [r[:2] for r in rows_of(spark, path)]
    assert keys == sorted([r[:2] for r in WANT if r[:2] not in (("a", "3"), ("b", "1"))] + [("c", "other")])


def test_contents_follow_the_rows(spark):
    """The content index against the rows, through changes, moves and deletions."""
    path = scratch_path(spark, "store")
    put = lambda rows: merge_into_store(frame(spark, [(*r[:3], None, None, 1) for r in rows]).drop("seq", "content_id").join(
        spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "source string, identifier string, content_id string"), ["source", "identifier"])
        .select(*[f.name for f in INVOICES.fields]), path)
    steps = [[("a", "1", 10 * DAY, "x"), ("a", "2", 10 * DAY + 5, "x"), ("b", "1", 10 * DAY, "y"), ("a", "3", None, "z")],
             [("a", "4", 10 * DAY + 9, "x"), ("a", "1", None, "w")], [("a", "2", 12 * DAY, None), ("a", "3", 10 * DAY, None)],
             [("a", "4", None, "y"), ("b", "1", None, "y")]] + [[("a", f"n{i}", 10 * DAY + i, "x")] for i in range(2)]
    for rows in steps:
        put(rows)
        ids = spark.createDataFrame([(c,) for c in "wxyz"], "content_id string")
        entries = {tuple(r) for r in store_module.content_days(spark, path, ids).select("content_id", "source", "day", "first", "last").collect()}
        want = {tuple(r) for r in read_store(spark, path).groupBy("content_id", "source", "day").agg(
            F.min("creation_date"), F.max("creation_date")).collect()}
        assert {e for e in entries if e[2] != "none"} == {w for w in want if w[2] != "none"}
        assert {w for w in want if w[2] == "none"} <= entries
    store_module.delete_rows(spark.createDataFrame([("a", "1"), ("a", "2")], "source string, identifier string"), path)
    left = {r[0] for r in store_module.content_days(spark, path, ids).select("content_id").collect()}
    assert left >= {"x", "y", "z"} and "w" not in left


def test_a_replay_writes_nothing(spark):
    """Rows that are stored as they are commit no version; of a batch only changed rows rewrite their day."""
    path = scratch_path(spark, "store")
    rows = [("a", "1", 10 * DAY, "m1", "x", 1), ("a", "2", 11 * DAY, "m2", None, 2), ("a", "3", None, "none", None, 3)]
    merge_into_store(frame(spark, rows), path, "seq")
    before = manifest(spark, path)
    merge_into_store(frame(spark, rows), path, "seq")
    assert manifest(spark, path) == before
    merge_into_store(frame(spark, [*rows[:1], ("a", "2", None, "other", None, 9), ("a", "4", 12 * DAY, "new", None, 9)]), path, "seq")
    after = manifest(spark, path)
    assert {p for p in after["data"] if after["data"][p] != before["data"].get(p)} == {"source=a/day=1970-01-12", "source=a/day=1970-01-13"}
    assert [r[:4] for r in rows_of(spark, path)] == [("a", "1", 10 * DAY, "m1"), ("a", "2", 11 * DAY, "other"), ("a", "3", None, "none"), ("a", "4", 12 * DAY, "new")]


def test_content_ids_packed_and_back(spark):
    ids = ["", "x", "ab" * 32, "AB" * 32, "ab" * 32 + "\n", "é" * 16, "g" * 64, "0" * 32, None]
    df = spark.createDataFrame([(c,) for c in ids], "content_id string").withColumn("packed", store_module.packed())
    rows = df.withColumn("back", store_module.unpacked("packed")).collect()
    assert [r["back"] for r in rows] == [r["content_id"] for r in rows]
    assert len({bytes(r["packed"]) for r in rows if r["packed"] is not None}) == len(ids) - 1


def test_a_deletion_moves_rows_once(spark, monkeypatch):
    """Days are written again slice by slice; rows of a repeated key stay as many as they were."""
    monkeypatch.setattr(store_module, "SLICE_BYTES", 100)
    path, write, plans = scratch_path(spark, "store"), store_module._write, []
    rows = [("a", str(i % 30), 10 * DAY + i % 3 * DAY, "m", None, 1) for i in range(40)]
    write_store(frame(spark, rows), path)

    def noted(df, path_, table, *more):
        if table == "data":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, path_, table, *more)

    monkeypatch.setattr(store_module, "_write", noted)
    store_module.delete_rows(spark.createDataFrame([("a", "3"), ("a", "4"), ("a", "unknown")], "source string, identifier string"), path)
    assert sorted(r[1] for r in rows_of(spark, path)) == sorted(str(i % 30) for i in range(40) if i % 30 not in (3, 4))
    assert len(plans) == 1 and plans[0].count("Repartition") == 1 and "Join" not in plans[0]

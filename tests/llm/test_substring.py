"""Removal of repeated byte strings against a count of all windows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from awkward_rows import ROWS, awkward, no_rows  # noqa: F401
from satledger.llm import queries, substring


def by_all_windows(rows, length):
    """Rows of id, bytes, merged ranges, kept bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(bytes(gone), np.uint8), [0])).astype(int))).tolist()
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(i), len(t), list(zip(edges[::2], edges[1::2])), kept))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((str(r["id"]), r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"]))
                   for r in substring.without_repeats(df, **options).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgé "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (30, 45, 60, 120, 300)]
    rows = [text(rng.randrange(200)) + rng.choice(passages) + text(rng.randrange(60)) + rng.choice(passages) + text(rng.randrange(9)) for _ in range(120)]
    base = text(700)
    for _ in range(40):  # near copies
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = "X"
        rows.append("".join(t))
    rows += ["a" * 500, "b" + "a" * 90, "ab" * 200, "abc" * 60 + "abd" * 40, base, base, text(39), text(40), text(41)]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,hot", [(1, 500), (2, 3)])
def test_repeats_equal_all_windows(spark, seed, hot, monkeypatch):
    """``hot`` of 3 sends most anchors through the window counts."""
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = by_all_windows(rows, 40)
    assert found(df, length=40, gram=16, hot=hot) == want
    assert sum(bool(w[2]) for w in want) > 50


def test_small_chunks_and_blocks(monkeypatch):
    """Texts longer than a block, chunks of few anchors, hot anchors of a chunk: in one
    process, through the task functions themselves."""
    monkeypatch.setattr(substring, "BLOCK", 512)
    rows = corpus(3)
    rows.append((900, "".join(t for _, t in rows[:30])))
    length, gram, parts = 40, 16, 3
    want = {r[0]: r[2] for r in by_all_windows(rows, length)}
    import pyarrow as pa

    monkeypatch.setattr(substring, "CHUNK", 700)
    monkeypatch.setattr(substring, "CHUNK_HOT", 2)
    monkeypatch.setattr(substring, "COLLECTION", 50)
    keys = {hashlib.md5(t.encode()).digest(): (i, t) for i, t in rows}
    batches = [pa.RecordBatch.from_pydict({"key": [hashlib.md5(t.encode()).digest() for _, t in rows[a:a + 20]], "text": [t for _, t in rows[a:a + 20]]})
               for a in range(0, len(rows), 20)]
    packed = list(substring._sign(parts, length, gram)(iter(batches)))
    marked = [r for p in range(parts) for b in substring._meet(iter([b for b in packed if b.column(0)[0].as_py() == p])) for r in b.to_pylist()]
    marks, sends = {k: [] for k in keys}, {}
    for r in marked:
        (sends.setdefault(r["key"], []) if r["send"] else marks[r["key"]]).append(r["marks"])
    cut = substring._cut(length, gram)(iter([pa.RecordBatch.from_arrays([
        pa.array(list(sends), pa.binary()), pa.array([keys[k][1] for k in sends]), pa.array(list(sends.values()), pa.list_(pa.binary()))], names=["key", "text", "marks"])]))
    contexts = sorted((tuple(r.values()) for b in cut for r in b.to_pylist()), key=lambda r: r[0])
    few = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*contexts), substring._CONTEXT_ARROW.types)], schema=substring._CONTEXT_ARROW)
    for b in substring._resolve(length, gram)(iter([few])):
        for r in b.to_pylist():
            marks[r["key"]].append(r["marks"])
    copied = Counter(t for _, t in rows)
    for k, (i, t) in keys.items():
        if copied[t] == 1:
            assert (substring.spans_of(marks[k], length) if marks[k] else []) == want[str(i)], i


def test_awkward_rows(awkward, no_rows):  # noqa: F811
    rows = [(i, t) for i, t, _ in ROWS]
    assert found(awkward, length=40, gram=16) == by_all_windows(rows, 40)
    assert substring.without_repeats(no_rows).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in by_all_windows(rows, 200))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op5_columnwise_suffix_dedup(spark, sf).collect())
    assert got == want and any(w[2] for w in want)


def test_columns_against_sorting():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(30)).encode() for _ in range(60)]
    hit = substring.repeated_starts(texts, np.full(60, 10), 20, 10)
    for i, t in enumerate(texts):
        for c in range(11):
            assert hit[i, c] == any(u[c:c + 20] == t[c:c + 20] for j, u in enumerate(texts) if j != i)

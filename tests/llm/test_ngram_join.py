"""PartEnum join against all pairs; components against union-find."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from awkward_rows import ROWS, awkward, no_rows  # noqa: F401
from satledger.llm import ngram_join, queries
from satledger.llm.components import components
from satledger.llm.ngram_join import Scheme, signatures


def word_list(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingle_set(text, k):
    w = word_list(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


def all_pairs(rows, k, percent):
    """Number of shingles and smallest reachable id by row."""
    sets = [shingle_set(t, k) for _, t in rows]
    joined = Union()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                joined.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(joined.top(i), []).append(d)
    return sorted((str(d), len(sets[i]), str(min((x for x in least[joined.top(i)] if x is not None), default=None) if sets[i] else d))
                  for i, (d, _) in enumerate(rows))


def found_groups(df, k, percent):
    return sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_groups(df, k, percent).collect())


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at:at + rng.randrange(2)] = [f"w{rng.randrange(400)}"] * rng.randrange(2)
    return words


def family_rows(seed):
    """Groups of variants around the threshold, variants of variants, copies, a shared passage."""
    rng = random.Random(seed)
    passage, rows = [f"p{i}" for i in range(30)], []
    for size, length in ((60, 90), (25, 40), (12, 300), (8, 12)):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        family = [base]
        for _ in range(size):
            family.append(edited(rng.choice(family[:6]), rng.randrange(1 + length // 12), rng))
        rows += [" ".join(w) for w in family] + [" ".join(base)] * 3
    for _ in range(25):
        rows.append(" ".join([f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 25))] + passage[:rng.randrange(31)]))
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_groups_equal_all_pairs(spark, seed, k, percent):
    rows = family_rows(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = all_pairs(rows, k, percent)
    assert len({w[2] for w in want}) < len(want) - 20
    assert found_groups(df, k, percent) == want


@pytest.mark.parametrize("members,elements", [(6, 1 << 21), (1024, 150)])
def test_hubs_too_large_for_a_task_equal_all_pairs(spark, monkeypatch, members, elements):
    monkeypatch.setattr(ngram_join, "LOCAL_MEMBERS", members)
    monkeypatch.setattr(ngram_join, "LOCAL_ELEMENTS", elements)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 12)
    rows = family_rows(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert found_groups(df, 5, 80) == all_pairs(rows, 5, 80)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_members_of_a_hub_meet_all_similar_ones(percent):
    """Whatever the hub: similar members are candidates, save two that are linked with it."""
    scheme, rng = Scheme(5, percent), np.random.default_rng(percent)
    for size in (3, 20, 150):
        base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        sets = []
        for _ in range(40):
            kept = base[rng.random(len(base)) < rng.uniform(0.3, 1)]
            new = rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 4)).astype(np.uint64)
            sets.append(np.unique(np.concatenate((kept, new, base[:1]))))
            sets.append(np.unique(np.concatenate((sets[-1][1:], rng.integers(0, 1 << 63, 1 + size // 30).astype(np.uint64)))))
        hub, sets = sets[0], sets[1:]
        rows = [ngram_join.difference_prefix(x, hub, scheme) for x in sets]
        linked, sizes, most = (np.array([r[i] for r in rows]) for i in range(3))
        at = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows])))
        names = np.concatenate([r[3] for r in rows])
        near = {(x, int(y)) for x, ys in ngram_join.near_members(sizes, most, linked, np.arange(len(sets)), names, at) for y in ys}
        similar = {(i, j) for j in range(len(sets)) for i in range(j) if not (linked[i] and linked[j])
                   and scheme.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
        assert similar <= near
        assert len(near) < len(sets) * (len(sets) - 1) // 2
        whole = np.zeros(len(sets), int)
        assert not list(ngram_join.near_members(sizes, most, linked, whole, names, at))


@pytest.mark.parametrize("members,elements", [(6, 1 << 21), (1024, 150), (1024, 1 << 21)])
def test_hubs_beyond_their_sketches_equal_all_pairs(spark, monkeypatch, members, elements):
    monkeypatch.setattr(ngram_join, "SKETCH_WORK", 20_000)
    monkeypatch.setattr(ngram_join, "LOCAL_MEMBERS", members)
    monkeypatch.setattr(ngram_join, "LOCAL_ELEMENTS", elements)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 12)
    rows = family_rows(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert found_groups(df, 5, 80) == all_pairs(rows, 5, 80)


def boilerplate_rows(count):
    """Texts of a shared line and words of their own, and a near copy of every tenth."""
    rng, line, rows = random.Random(11), " ".join(f"line{i}" for i in range(14)), []
    for i in range(count):
        own = [f"x{i}y{rng.randrange(10 ** 9)}" for _ in range(46)]
        rows.append((2 * i, f"{line} {' '.join(own)}"))
        if i % 10 == 0:
            rows.append((2 * i + 1, f"{line} {' '.join(own[:-1])} other{i}"))
    return rows


def test_texts_that_share_a_line_are_not_compared(spark, monkeypatch):
    """Members of a hub that only share a line are told apart by sketches: the texts that
    are compared follow the near copies, not the groups."""
    compared, plain = [], ngram_join._compared

    def counted(pairs, *more):
        found = plain(pairs, *more)
        compared.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_compared", counted)
    rows = boilerplate_rows(400)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert found_groups(df, 5, 80) == all_pairs(rows, 5, 80)
    assert sum(compared) <= 2 * 40


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_sketches_keep_similar_sets(percent):
    """Sketches are never further apart than the sets, and mostly rule out the others."""
    scheme, rng = Scheme(5, percent), np.random.default_rng(percent)
    ruled_out = dissimilar = 0
    for size in (1, 2, 7, 30, 200, 3000):
        sets = [np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(3)]
        for _ in range(30):
            base = sets[rng.integers(3)]
            new = rng.integers(0, 1 << 63, rng.integers(0, 2 + size // 8)).astype(np.uint64)
            sets.append(np.unique(np.concatenate((base[rng.random(len(base)) < rng.uniform(0.6, 1)], new, base[:1]))))
        sizes, cells = np.array([len(s) for s in sets]), [ngram_join.sketch(s) for s in sets]
        linked, component = rng.random(len(sets)) < 0.3, rng.integers(0, 12, len(sets))
        near = {frozenset((x, int(y))) for x, ys in ngram_join.sketched_members(scheme, sizes, linked, component, cells) for y in ys}
        for j in range(len(sets)):
            for i in range(j):
                similar = scheme.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j])
                possible = ngram_join.may_link(scheme, int(sizes[i]), cells[i], int(sizes[j]), cells[j])
                assert possible or not similar
                if component[i] != component[j] and not (linked[i] and linked[j]):
                    assert frozenset((i, j)) in near or not similar
                else:
                    assert frozenset((i, j)) not in near
                if size >= 30 and not similar:
                    dissimilar += 1
                    ruled_out += not possible
    assert ruled_out > 0.6 * dissimilar


def test_signature_of_one_node_in_several_chunks_is_no_group():
    """Copies in different chunks send a signature twice; several nodes still meet."""
    nodes, sig = [b"a" * 16, b"b" * 16], np.arange(5, dtype=np.uint64)
    packed = [ngram_join._pack(0, 0, False, sig, np.zeros(5, np.int64), nodes) for _ in range(2)]
    assert not [r for batch in ngram_join._meet(packed) for r in batch.to_pylist()]
    packed.append(ngram_join._pack(0, 0, False, sig[3:], np.ones(2, np.int64), nodes))
    met = [(r["key"], r["node"]) for batch in ngram_join._meet(packed) for r in batch.to_pylist()]
    assert sorted(met) == [(k, n) for k in (3, 4) for n in nodes]


def test_awkward_rows(awkward, no_rows):  # noqa: F811
    rows = [(d, t) for d, t, _ in ROWS]
    assert found_groups(awkward, 3, 90) == all_pairs(rows, 3, 90)
    assert ngram_join.similar_groups(no_rows).count() == 0


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in queries.op10_partenum_ngram_join(spark, sf).collect())
    assert got == all_pairs(rows, 3, 90)


def test_representatives(spark, awkward):  # noqa: F811
    kept = ngram_join.representatives(awkward, 3, 90)
    assert kept.columns == awkward.columns
    groups = Counter(tuple(word_list(t)) for _, t, _ in ROWS if word_list(t))
    texts = Counter(tuple(word_list(r["text"])) for r in kept.collect())
    assert texts.pop(()) == 3 and set(texts) == set(groups) and set(texts.values()) == {1}
    unique = spark.createDataFrame(family_rows(4), "doc_id bigint, text string")
    groups = ngram_join.similar_groups(unique, 5, 80).collect()
    assert {r["doc_id"] for r in ngram_join.representatives(unique).collect()} == {r["component_id"] for r in groups}


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_similar_sets_share_a_signature(percent):
    scheme, rng = Scheme(3, percent), np.random.default_rng(percent)
    for size in (1, 2, 5, 9, 30, 100, 700):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            keep = rng.random(len(a)) < rng.uniform(percent / 100, 1)
            b = np.unique(np.concatenate((a[keep], rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 10)).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 0 < both < max(len(a), len(b)) and scheme.linked(both, len(a), len(b)):
                assert len(np.intersect1d(signatures([a], scheme)[0], signatures([b], scheme)[0]))
    pair = signatures([a, b], scheme)
    assert all(set(pair[0][pair[1] == i]) == set(signatures([x], scheme)[0]) for i, x in enumerate((a, b)))


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    joined = Union()
    for a, b in links:
        joined.join(a, b)
    want = {(x, joined.top(x)) for x in list(joined) if joined.top(x) != x}
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {tuple(r) for r in got} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

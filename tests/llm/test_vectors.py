"""Whitening and hard negatives against brute force."""
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from satledger.llm import negatives, queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, x binary, n int, key int, `a.b` string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "clash", None, 1, 2, "dot") for i, v, y in rows], SCHEMA).repartition(parts)


def usable(v, length):
    return v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v)


def random_rows(seed, n=160, length=4, span=3, labels=3):
    """Few different entries: equal scores, equal rows and a label with a third of them."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-span, span) / 2 for _ in range(length)], max(0, rng.randrange(-2, labels))) for i in range(n)]
    bad = [[1.0] * (length + 1), None, [], [None] * length, [math.nan] + [1.0] * (length - 1), [math.inf] + [0.0] * (length - 1)]
    return rows + [(n + k, v, 1) for k, v in enumerate(bad)] + [(n + 10, [0.5] * length, None), (None, [0.5] * length, 1), rows[50], rows[7], rows[7]]


# whitening ---------------------------------------------------------------------

def expected(rows, length, grid=whitening.GRID, shift=whitening.SHIFT):
    kept = [(i, [math.floor(grid * c) + shift for c in v]) for i, v, _ in rows if usable(v, length)]
    n, sums = len(kept), [sum(x[d] for _, x in kept) for d in range(length)]
    away = [(i, [n * a - s for a, s in zip(x, sums)]) for i, x in kept]
    cov = np.array([[float(Fraction(sum(z[a] * z[b] for _, z in away), n**3)) for b in range(length)] for a in range(length)])
    return n, Counter((i, sum(c * c for c in z)) for i, z in away), cov, dict((i, np.array(z) / n) for i, z in away)


def check_whitening(found, rows, length, components=8):
    n, deviations, cov, away = expected(rows, length)
    values = np.linalg.eigvalsh(cov)[::-1][:components]
    found = found.collect()
    assert {r["n"] for r in found} == {n}
    assert Counter((r["id"], int(r["deviation"])) for r in found) == deviations
    y = np.array([r["whitened"] for r in found])
    assert y.shape == (n, min(components, length))
    assert np.allclose(found[0]["explained"], values / np.trace(cov), rtol=1e-9)
    assert np.abs(y.T @ y / n - np.eye(y.shape[1])).max() < 1e-9 and found[0]["identity_error"] < 1e-9
    z = np.array([away[r["id"]] for r in found])
    for k, e in enumerate(values):  # the projection of an eigenvector: cov w = e w for w = z' y / (n sqrt(e))
        w = z.T @ y[:, k] / n / math.sqrt(e)
        assert np.allclose(cov @ w, e * w, rtol=1e-9, atol=1e-9 * e) and math.isclose(w @ w, 1, rel_tol=1e-9)


def test_whitening_is_exact(spark):
    for seed, components in ((1, 8), (2, 2)):
        rows = random_rows(seed)
        check_whitening(whitening.whitened(table(spark, rows), components=components), rows, 4, components)


def test_covariance_by_polarisation_is_exact():
    """Sums of squares around any centre give the exact matrix, whatever the numbers' size."""
    rng = random.Random(3)
    for size in (10, 10**6, 10**12):
        x = np.array([[rng.randint(-size, size) for _ in range(5)] for _ in range(40)], np.int64)
        sums = [int(s) for s in x.astype(object).sum(axis=0)]
        w = whitening.Whitening(40, sums, np.zeros(0), np.zeros((5, 0)), 0.0)
        squares = [a + b for a, b in zip(whitening._squares(x[:17] - w.centres()), whitening._squares(x[17:] - w.centres()))]
        away = [[40 * int(a) - s for a, s in zip(row, sums)] for row in x]
        want = [[float(Fraction(sum(z[a] * z[b] for z in away), 40**3)) for b in range(5)] for a in range(5)]
        assert whitening.covariance(40, sums, squares, w.centres().tolist()).tolist() == want
        assert w.deviations(x) == [sum(c * c for c in z) for z in away]


def test_whitening_of_little(spark):
    same = whitening.whitened(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in same] == [
        (2, 0, [None, None], [0.0, 0.0], 0.0)] * 2
    line = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)])).orderBy("id").collect()
    assert [r["whitened"][1] for r in line] == [None] * 5 and abs(abs(line[0]["whitened"][0]) - math.sqrt(2)) < 1e-9
    for nothing in ([], [(1, None, 0), (2, [], 0)]):
        found = whitening.whitened(table(spark, nothing))
        assert found.count() == 0 and found.columns == ["id", "deviation", "whitened", "n", "explained", "identity_error"]
    huge = whitening.whitened(table(spark, [(1, [1e300], 0), (2, [-1e300], 0)])).collect()
    assert {int(r["deviation"]) for r in huge} == {(2 * 1024 * 2**42) ** 2}


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviations, cov, _ = expected(rows, 64)
    found = queries.op12_polarisation_whitening(spark, SF).collect()
    assert len(found) == 8 * n and {r["component"] for r in found} == set(range(1, 9))
    assert Counter((r["vec_id"], r["deviation"]) for r in found) == Counter({k: 8 * v for k, v in deviations.items()})
    shares = {r["component"]: r["explained"] for r in found}
    assert np.allclose([shares[k] for k in range(1, 9)], np.linalg.eigvalsh(cov)[::-1][:8] / np.trace(cov), rtol=1e-9)
    assert {r["identity_error"] for r in found}.pop() < 1e-4


# hard negatives ------------------------------------------------------------------

def brute(rows, length, anchor, positives=5, k=3, low=50, high=95, grid=256):
    kept = [(i, [math.floor(grid * c) for c in v], y) for i, v, y in rows if usable(v, length) and y is not None and i is not None]
    out = Counter()
    for i, x, y in kept:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, z)), j, w) for j, z, w in kept if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            inside = [s for s in scored if s[2] != y and low * -p <= 100 * -s[0] <= high * -p][:k]
            out.update((i, j, r, m, -p, -s) for r, (s, m, _) in enumerate(inside, 1))
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df):
    assert df.columns == COLUMNS
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("seed,options", [(4, {}), (5, {"positives": 2, "negatives": 1}), (6, {"low": -50, "high": 100})])
def test_hard_negatives(spark, seed, options):
    rows = random_rows(seed)
    want = brute(rows, 4, lambda i: i % 10 == 0, options.get("positives", 5), options.get("negatives", 3), options.get("low", 50), options.get("high", 95))
    assert len(want) > 20
    assert mined(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, **options)) == want


def test_rows_of_a_group_come_in_tiles(monkeypatch):
    """What a task keeps does not depend on how many rows it compares at a time."""
    rng = random.Random(8)
    ids, labels = np.arange(300)[::-1].copy(), np.array([rng.randrange(3) for _ in range(300)])
    x = np.array([[rng.randint(-3, 3) for _ in range(4)] for _ in range(300)], np.int16)
    block = (ids.tobytes(), labels.tobytes(), ids.tobytes(), np.tile([0, 9, -5, 0], 300).astype(np.int64).tobytes(), x.tobytes(), False)
    found = []
    for tile in (7, 1000):
        monkeypatch.setattr(negatives, "TILE", tile)
        found.append([[tuple(c.tolist() for c in part) for part in find(negatives._Group([block], 4, by_label), block, 4, 3)]
                      for find, by_label in ((negatives._positives, True), (negatives._negatives, False))])
    assert found[0] == found[1] and len(found[0][0][0][0]) > 100


def test_hard_negatives_of_large_numbers(spark):
    """Scores beyond 24 and beyond 53 bits stay exact."""
    rng = random.Random(7)
    for size in (200.0, 3e4, 4e6):
        rows = [(i, [rng.uniform(-size, size) for _ in range(3)], i % 3) for i in range(90)]
        rows += [(100 + i, [c + rng.choice([0, 1 / 256]) for c in rows[i][1]], (i + 1) % 3) for i in range(60)]
        assert mined(negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0, high=100)) == brute(
            rows, 3, lambda i: i % 5 == 0, high=100)


def test_hard_negatives_of_little(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [0.9], 2)]):
        assert mined(negatives.hard_negatives(table(spark, rows), F.col("vec_id") == 0)) == Counter()
    odd = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [1.0], 1, "x"), (2, [0.75], 2, "x")], "`v.id` bigint, `e.m` array<float>, `l.l` int, vec_id string")
    found = negatives.hard_negatives(odd, F.col("`v.id`") == 0, "l.l", "v.id", "e.m")
    assert mined(found) == Counter([(0, 1, 1, 2, 65536, 49152)])

"""Toxicity and quality: held-out accuracy, no leak of held-out labels, odd rows."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from awkward_rows import ROWS, awkward, no_rows  # noqa: F401
from satledger.llm import quality, queries, toxicity
from satledger.llm.toxicity import PATTERN_VOTERS, LabelModel, fit_linear

SF = "/root/testdata/sf0.1"
OPERATORS = [(toxicity, "toxic", "toxicity", 3, 1, queries.op1_weak_supervision_toxicity),
             (quality, "quality", "quality", 4, 2, queries.op3_compression_quality)]


def held(i, parts, out):
    return zlib.crc32(str(i).encode()) % parts == out


@pytest.mark.parametrize("module,label,score,parts,out,query", OPERATORS, ids=["toxicity", "quality"])
def test_held_out_accuracy(spark, module, label, score, parts, out, query):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"], parts, out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    test = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    yes, no = [t for t in test if t[0]], [t for t in test if not t[0]]
    # a sixth of this table's toxic labels stand at texts without any term of abuse
    assert sum(t[1] for t in yes) >= (0.75 if label == "toxic" else 0.95) * len(yes)
    assert sum(t[1] for t in no) <= (0.01 if label == "toxic" else 0.1) * len(no)


@pytest.mark.parametrize("module,label,score,parts,out,query", OPERATORS, ids=["toxicity", "quality"])
def test_held_out_labels_are_not_read(spark, module, label, score, parts, out, query):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn(label, F.when(toxicity.remainder(F.col("doc_id"), parts) == out, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({r["doc_id"]: r[score] for r in module.scored(docs, x).select("doc.doc_id", score).collect()} for x in (labels, turned))
    assert a == pytest.approx(b, abs=1e-12)


@pytest.mark.parametrize("module,label,score,parts,out,query", OPERATORS, ids=["toxicity", "quality"])
def test_awkward_rows(spark, awkward, no_rows, module, label, score, parts, out, query):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200, 260)] + [(None, 1, 1), (7, None, None), (9, 1, 0)],
                                   "doc_id bigint, toxic int, quality int")
    for given in (labels, labels.limit(0)):
        found = module.scored(awkward, given)
        rows = found.collect()
        assert len(rows) == len(ROWS) and all(0 <= r[score] <= 1 for r in rows)
        assert set(found.schema["doc"].dataType.names) == set(awkward.columns) - {"text"}
        same = {}
        for r in rows:  # equal texts have equal scores
            assert same.setdefault(r["text"] or "", r[score]) == r[score]
        assert module.scored(no_rows, given).count() == 0


def test_label_model_finds_rates_and_correlations():
    """Voters of known rates, two of them nearly copies of one another, few labels."""
    rng = np.random.default_rng(1)
    n, rates = 40_000, [(0.9, 0.02), (0.7, 0.01), (0.8, 0.05), (0.6, 0.02)]
    toxic = rng.random(n) < 0.1
    votes = [np.where(toxic, rng.random(n) < a, rng.random(n) < b) for a, b in rates]
    votes.append(np.where(rng.random(n) < 0.95, votes[3], ~votes[3]))
    votes += [rng.random(n) < 0.3 for _ in PATTERN_VOTERS]
    pattern = sum(v.astype(np.int64) << i for i, v in enumerate(votes))
    label = np.where(np.arange(n) < 2000, toxic, -1)
    seen, counts = np.unique(np.stack([pattern, label]), axis=1, return_counts=True)
    model = LabelModel(seen[0], counts, seen[1], len(votes))
    assert model.prior == pytest.approx(0.1, abs=0.02)
    assert any({3, 4} <= set(b) for b in model.blocks) and [0] in model.blocks
    for v, (a, b) in enumerate(rates[:3]):
        got = model.rates[model.blocks.index([v])]
        assert got[0][1] == pytest.approx(a, abs=0.05) and got[1][1] == pytest.approx(b, abs=0.02)
    assert model.posterior(np.array([0b00111]))[0] > 0.95 and model.posterior(np.array([0]))[0] < 0.02


def test_linear_classifier_learns_soft_labels():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 6)) < 0.2
    soft = np.where(x[:, 1] | x[:, 4], 0.97, 0.02)
    rows, cols = np.nonzero(x)
    w, bias = fit_linear(rows, cols, len(x), 6, soft, np.zeros(6))
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.mean((p >= 0.7) == (soft > 0.5)) > 0.99


def test_compression_tells_texts_apart():
    good, bad = [b"the cat sat on the mat and looked at the dog %d" % i for i in range(400)], [b"$$$ %%%% &&& ### *** %d" % i for i in range(400)]
    sizes = quality.Sizes(quality.dictionary(good), quality.dictionary(bad))
    assert sizes.features(b"the dog sat on the mat")[0] > 0 > sizes.features(b"$$$ %%%% &&& ### *** 7 $$$ %%%% &&& ### ***")[0]
    assert len(sizes.features(b"")) == 5 and sizes.features(b"x" * 10_000)[4] > 0

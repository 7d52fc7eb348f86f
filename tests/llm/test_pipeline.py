"""The pipeline, stage by stage, against brute force on what each stage was given."""
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from awkward_rows import ROWS, awkward, no_rows  # noqa: F401
from satledger.llm import pipeline_stages, toxicity
from satledger.llm.common import store
from test_ngram_join import all_pairs
from test_simple_operators import hits_by_brute_force, targets_by_resharing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.collect(), store(stage(spark, docs, SF), f"test-{name}")
        out[name] = before, docs.collect()
        assert name == "sharding" or docs.columns == columns
    return out


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    clean = [i for i, t in toxic.items() if not t]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    abuse = set(" ".join(toxicity.LEXICONS.values()).split())
    insulted = [r["doc_id"] for r in before if len(abuse & set(re.findall(r"\w+", r["text"].lower()))) >= 2]
    assert insulted and not any(i in kept for i in insulted)
    assert {(r["doc_id"], r["text"], r["source"]) for r in after} <= {(r["doc_id"], r["text"], r["source"]) for r in before}


def test_ngram_jaccard_join(steps):
    before, after = steps["ngram_jaccard_join"]
    groups = all_pairs([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(str(r["doc_id"]) for r in after) == sorted({c for _, _, c in groups})


def test_decontamination(spark, steps):
    before, after = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in before if not hits_by_brute_force(r["text"], items)[1]]
    assert sorted(r["doc_id"] for r in after) == sorted(clean) and len(clean) < len(before)


def test_mixing(steps):
    before, after = steps["mixing"]
    copies, sizes, largest, taken = Counter(r["doc_id"] for r in after), Counter(), Counter(), Counter()
    for r in before:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
        taken[r["source"]] += n * copies[r["doc_id"]]
    for source, target in targets_by_resharing(sizes).items():
        assert abs(taken[source] - target) <= largest[source]
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in before}


def test_sharding(steps):
    before, after = steps["sharding"]
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
    size = Counter()
    for r in after:
        size[r["shard"]] += r["size"]
    total, largest = sum(len(r["text"].encode()) + 16 for r in before), max(r["size"] for r in after)
    assert sum(size.values()) == total and all(abs(size[s] - total / 40) < 2 * largest for s in range(40))
    assert Counter(r["text_crc32"] for r in after) == Counter(zlib.crc32(r["text"].encode()) for r in before)


def test_run_equals_the_stages(spark, steps):
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted(found) == sorted(steps["sharding"][1])


def test_results_outlive_later_stages(spark, monkeypatch):
    """A result that nobody has read yet is whole after another run and after other stages."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    first, second = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    places = pipeline_stages.sharding(spark, pipeline_stages.mixing(spark, docs, SF), SF)
    pipeline_stages.mixing(spark, docs, SF)
    assert sorted(first.collect()) == sorted(second.collect()) == sorted(places.collect())


@pytest.mark.parametrize("stage", range(5), ids=[n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows(spark, awkward, no_rows, stage):  # noqa: F811
    """Nulls, empty and long texts, repeated rows, clashing extra columns, an empty table."""
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, awkward, SF)
    if name != "sharding":
        assert got.columns == awkward.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} <= {i for i, *_ in ROWS}
    if name in ("toxicity", "sharding"):
        assert len(rows) == len(ROWS)
    assert run(spark, no_rows, SF).count() == 0

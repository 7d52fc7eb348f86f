"""Edit-aware counts against a full encoding of the edited text."""
import random

import pytest
from pyspark.sql import functions as F

from awkward_rows import ROWS, awkward, no_rows  # noqa: F401
from satledger.llm import queries, tokens
from satledger.llm.common import store

ALPHABET = ["a", "b", " ", "  ", "\n", "\n\n", "'", "'l", "l", "re", "1", "23", "!", "é", "漢", "\U0001f600", "word", "Xy", "\t", "."]


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read())


def test_trees_equal_full_encoding(encoder):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    for _ in range(400):
        text = some(rng.randrange(60))
        tree = tokens.SegmentTree(encoder, text)
        assert tree.tokens == encoder.whole(text) and tree.characters == len(text)
        for _ in range(6):
            start, length, new = rng.randrange(len(text) + 3), rng.randrange(6), some(rng.randrange(4))
            start = min(start, len(text))
            text = text[:start] + new + text[start + length:]
            tree.edit(start, length, new)
            assert tree.text() == text
            assert [p for s in tree.slots for p in s] == encoder.split(text)
            assert tree.tokens == encoder.whole(text) and tree.characters == len(text)


def test_only_the_region_is_encoded_again(encoder):
    text = " ".join(f"word{i % 91} and" for i in range(5000))
    tree = tokens.SegmentTree(encoder, text)
    tree.edit(20_000, 4, "changed")
    assert 0 < tree.reencoded < 12
    long = tokens.SegmentTree(encoder, "x" + "a" * 5000 + " end")
    long.edit(2500, 0, "b")
    assert long.text() == "x" + "a" * 2499 + "b" + "a" * 2501 + " end" and long.tokens == encoder.whole(long.text())


def test_an_edit_inside_an_insertion_encodes_little(encoder):
    """What was inserted is as fine as the rest; also text typed into an empty document."""
    tree = tokens.SegmentTree(encoder, "begin and end")
    tree.edit(6, 0, " ".join(f"new{i % 83}" for i in range(20_000)) + " ")
    before = tree.reencoded
    tree.edit(tree.characters // 2, 1, "X")
    assert tree.reencoded - before < 3 * tokens.SLOT and tree.tokens == encoder.whole(tree.text())
    typed = tokens.SegmentTree(encoder, "")
    for i in range(3000):
        typed.edit(typed.characters, 0, f" w{i % 71}")
    assert typed.reencoded < 3000 * 2 * tokens.SLOT
    assert typed.tokens == encoder.whole(typed.text()) and sum(n for _, n in typed.leaves()) == typed.tokens


def apply(text, edits):
    for start, length, new in edits:
        start = min(start, len(text))
        text = text[:start] + new + text[start + length:]
    return text


def check(rows, texts, encoder):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        text = text or ""
        n = len(text)
        after = apply(text, [(n // 4, 12, ""), (n // 2, 0, " [edited] "), (n * 3 // 4, 5, "'re é\U0001f600 12")] if r["edited"] else [])
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (encoder.whole(text), encoder.whole(after), len(after))


def test_query(spark, encoder):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op7_edit_aware_token_counts(spark, sf).withColumn("edited", F.lit(True)).collect()
    check(found, [texts[r["doc_id"]] for r in found], encoder)
    assert sum(r["n_reencoded"] for r in found) < 0.1 * sum(r["n_leaves"] for r in found)


def test_awkward_rows(awkward, no_rows, encoder):  # noqa: F811
    docs = awkward.withColumn("edits", F.when(F.col("text").isNotNull(), tokens.sample_edits()))
    found = tokens.recounted(docs).withColumn("edited", F.lit(True)).collect()
    by_tokens = sorted((encoder.whole(t or ""), i or 0) for i, t, _ in ROWS)
    assert sorted((r["n_tokens"], r["id"] or 0) for r in found) == by_tokens
    texts = {i: t for i, t, _ in ROWS}
    check([{**r.asDict(), "edited": texts[r["id"]] is not None} for r in found], [texts[r["id"]] for r in found], encoder)
    assert tokens.recounted(no_rows.withColumn("edits", tokens.sample_edits())).count() == 0


def test_kept_leaves_are_not_split_or_encoded_again(encoder, monkeypatch):
    text = "The word isn't 1 234  here, 漢字 \U0001f600 at all" * 3
    leaves = tokens.SegmentTree(encoder, text).leaves()
    whole = encoder.whole(text)
    monkeypatch.setattr(encoder, "split", None)
    monkeypatch.setattr(encoder, "count", None)
    monkeypatch.setattr(encoder, "counts", None)
    tree = tokens.SegmentTree(encoder, text, leaves)
    assert (tree.tokens, tree.characters, tree.text(), tree.leaves()) == (whole, len(text), text, leaves)


def test_later_edits_against_a_written_table(spark, awkward, no_rows, encoder):  # noqa: F811
    first = store(tokens.kept_trees(awkward.withColumn("e", tokens.sample_edits()), edits_col="e"), "test-trees")
    second = tokens.kept_trees(first.withColumn("e", tokens.sample_edits()), "id", edits_col="e", leaves_col="leaves")
    once = {(r["id"], r["text"]): r for r in first.collect()}
    for r in second.collect():
        assert r["n_tokens"] == encoder.whole(r["text"]) == sum(x["tokens"] for x in r["leaves"])
        assert r["n_chars"] == len(r["text"]) == sum(x["length"] for x in r["leaves"])
        assert [len(p) for p in encoder.split(r["text"])] == [x["length"] for x in r["leaves"]]
    wanted = [(i, edited("" if t is None else edited(t))) for i, t, *_ in ROWS]  # no places in a null text
    assert sorted(map(str, wanted)) == sorted(str((r["id"], r["text"])) for r in second.collect())
    assert len(once) and tokens.kept_trees(no_rows).count() == 0


def edited(text):
    n = len(text)
    for start, length, new in ((n // 4, 12, ""), (n // 2, 0, " [edited] "), (int(n * 0.75), 5, "'re é\U0001f600 12")):
        text = text[:start] + new + text[start + length:]
    return text

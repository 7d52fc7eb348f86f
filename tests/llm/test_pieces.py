"""Encoding and decoding against the sentencepiece library."""
import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from awkward_rows import ROWS, awkward, no_rows  # noqa: F401
from satledger.llm import pieces, queries

SYMBOLS = ["a", "e", "t", "h", " ", "  ", "▁", "in", "er", "ing", "\n", "é", "日", "本", "\U0001d518", "\t", "<s>", "<0x0A>", "0", "1",
           ".", "...", "!!", "====", "a" * 7, "\xa0", "　", "힣", "́", "\x00", "the", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def tools():
    with open(pieces.MODEL, "rb") as f:
        return pieces._tools(f.read())


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_ids_equal_the_library(library, tools):
    rng, (encoder, _) = random.Random(11), tools
    texts = ["".join(rng.choice(SYMBOLS) for _ in range(rng.randrange(50))) for _ in range(8000)] + [" " * n for n in range(70)]
    for bos, eos in ((True, True), (False, False), (True, False)):
        want = library.encode(texts, add_bos=bos, add_eos=eos, num_threads=1)
        assert [encoder.ids(t, bos, eos) for t in texts] == list(map(packed, want))


def test_cutting_changes_nothing(library, tools):
    """The table over whole texts and over segments gives the same ids."""
    rng, (encoder, _) = random.Random(12), tools
    for _ in range(300):
        text = "".join(rng.choice(SYMBOLS) for _ in range(rng.randrange(1, 60)))
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert encoder.segment(marked) == library.encode(text)


def test_each_prefix_has_one_last_token(library, tools):
    encoder, _ = tools
    for text in ("▁encyclopedia", "▁▁▁▁▁the", "=======a", "▁internationalisation"):
        for end in range(1, len(text) + 1):
            prefix = text[:end]
            ids = encoder.segment(prefix)
            ends = [i for p, i in encoder.pieces.id.items() if prefix.endswith(p)]
            fit = [i for i in ends if encoder.compatible(
                encoder.segment(prefix[:-len(encoder.pieces.text[i])])[-1] if len(encoder.pieces.text[i]) < end else -1, i)]
            assert fit == [ids[-1]]


def test_any_ids_decode_as_the_library_does(library, tools):
    rng, (_, decoder) = random.Random(13), tools
    one = lambda: rng.choice([0, 1, 2, 28705, 259, 261, rng.randint(3, 258), rng.randint(195, 258), rng.randint(259, 31999)])
    rows = [[one() for _ in range(rng.randrange(12))] for _ in range(20_000)]
    flat = np.array([i for r in rows for i in r])
    cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    assert decoder.texts(flat, cuts) == [library.decode(r) for r in rows]
    with pytest.raises(IndexError):
        decoder.texts(np.array([32000]), np.array([0, 1]))


def test_awkward_rows(spark, awkward, no_rows, library):  # noqa: F811
    clash = awkward.withColumnRenamed("h", "ids").withColumnRenamed("source", "Decoded")
    found = pieces.decoded(pieces.encoded(clash), "ids").columns
    assert found == [*clash.columns, "ids", "decoded"]
    rows = pieces.listed(pieces.encoded(awkward)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert bytes(r["ids"]) == packed(want) and r["id_list"] == want and r["a.b"] == "dot"
    back = pieces.decoded(pieces.encoded(awkward)).collect()
    assert sorted((r["text"] or "") for r in back) == sorted(r["decoded"] for r in back)
    assert pieces.decoded(pieces.encoded(no_rows)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id int, ids binary")
    assert {r["decoded"] for r in pieces.decoded(nulls).collect()} == {""}
    assert {tuple(r["id_list"]) for r in pieces.listed(nulls).collect()} == {()}


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_merge_table_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()

"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is split into pre-tokens by the tokenizer's pattern; each is a leaf with
its characters and its number of tokens, and inner nodes hold the sums.  An edit
finds its leaves by descent, re-encodes the text from the last leaf that cannot
see the edit to the first old boundary that the new split meets again, and
updates the sums on the paths of the leaves it replaced.  All else stays.

The pattern looks ahead only, and by ``LOOK`` characters at most, so a leaf
depends on its own text and the next ``LOOK`` characters, and from an equal
boundary with equal text ahead the split is the same.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger.llm.common import numbered, place, small_batches

#: Rank file of the byte-level vocabulary (a parameter; never copied).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters behind its end that a pre-token's split may depend on.
LOOK = 3
#: Pre-tokens that a slot may hold.
SLOT = 16
#: Pre-tokens whose number of tokens a task remembers.
REMEMBERED = 1 << 18


class Encoder:
    """Pre-tokens of a text and their numbers of tokens."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self._split = regex.compile(PATTERN)
        self._known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self._split.findall(text)

    def matches(self, text: str, start: int) -> Iterator[str]:
        return (m[0] for m in self._split.finditer(text, start))

    def count(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            n = len(self._encoding.encode_ordinary(piece))
            if len(piece) < 64:
                self._known[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        try:
            return list(map(self._known.__getitem__, pieces))
        except KeyError:
            return [self.count(p) for p in pieces]

    def whole(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


class SegmentTree:
    """Sums of characters and tokens over a document's pre-token slots.

    An edit leaves the number of slots as it is: the first slot of a replaced run
    takes all of its new pre-tokens, the others become empty.  A slot of more than
    ``SLOT`` pre-tokens is spread over slots of its own: the tree is laid out anew
    from the numbers it holds, without encoding."""

    def __init__(self, encoder: Encoder, text: str, leaves: list[tuple[int, int]] | None = None):
        """With ``leaves`` (characters and tokens of each pre-token of ``text``, see
        :meth:`leaves`) nothing is split or encoded again."""
        self.encoder = encoder
        if leaves is None:
            pieces = encoder.split(text)
            tokens = encoder.counts(pieces)
        else:
            ends = np.cumsum([n for n, _ in leaves]).tolist()
            pieces, tokens = [text[a:b] for a, b in zip([0, *ends], ends)], [n for _, n in leaves]
        self._lay(pieces, tokens)
        self.reencoded = 0

    def _lay(self, pieces: list[str], tokens: list[int]) -> None:
        """A slot for each pre-token, and the sums above them."""
        self.slots: list[list[str]] = [[p] for p in pieces] or [[]]
        self.several: dict[int, list[int]] = {}  # tokens of each pre-token of a slot that holds several
        self.size = 1 << max(0, len(self.slots) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if pieces:
            self.sums[self.size:self.size + len(pieces), 0] = list(map(len, pieces))
            self.sums[self.size:self.size + len(pieces), 1] = tokens
        at = self.size
        while at > 1:
            self.sums[at // 2:at] = self.sums[at:2 * at:2] + self.sums[at + 1:2 * at:2]
            at //= 2

    @property
    def characters(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(p for s in self.slots for p in s)

    def leaves(self) -> list[tuple[int, int]]:
        """Characters and tokens of each pre-token."""
        out: list[tuple[int, int]] = []
        for k, (slot, sums) in enumerate(zip(self.slots, self.sums[self.size:].tolist())):
            out += [tuple(sums)] if len(slot) == 1 else list(zip(map(len, slot), self.several.get(k, ())))
        return out

    def find(self, offset: int) -> tuple[int, int]:
        """The slot that holds the character at ``offset``, and where it begins."""
        at, begin = 1, 0
        while at < self.size:
            at *= 2
            left = int(self.sums[at, 0])
            if offset >= begin + left:
                begin += left
                at += 1
        return min(at - self.size, len(self.slots) - 1), begin

    def _set(self, slot: int, pieces: list[str]) -> None:
        self.slots[slot] = pieces
        tokens = self.encoder.counts(pieces)
        self.several.pop(slot, None)
        if len(pieces) > 1:
            self.several[slot] = tokens
        at = self.size + slot
        self.sums[at] = sum(map(len, pieces)), sum(tokens)
        while at > 1:
            at //= 2
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters at ``start``; both are cut to the text."""
        start = min(max(0, start), self.characters)
        end = min(start + max(0, length), self.characters)
        if start == end and not replacement:
            return
        first, begin = self.find(max(0, start - LOOK))
        # the text from there on: slots are added until the new split meets an old boundary
        last, _ = self.find(max(start, end - 1))
        last = max(last, first)
        old = [p for s in self.slots[first:last + 1] for p in s]
        region = "".join(old)
        covered = begin + len(region)
        text = region[:start - begin] + replacement + region[end - begin:]
        shift = len(replacement) - (end - start)
        while True:
            ahead, more = "", last + 1  # enough to look ahead and to go on to the next boundaries
            while more < len(self.slots) and len(ahead) < LOOK + 64:
                ahead += "".join(self.slots[more])
                more += 1
            boundaries, at = {covered + shift - begin}, covered + shift - begin
            edges = {at: last}
            for k in range(last + 1, more):
                width = sum(map(len, self.slots[k]))
                at += width
                edges[at] = k
            boundaries = set(edges)
            pieces, at, stop = [], 0, None
            everything = text + ahead
            final = more >= len(self.slots)
            for piece in self.encoder.matches(everything, 0):
                if not final and at + len(piece) + LOOK > len(everything):
                    break  # its end may depend on text not read yet
                pieces.append(piece)
                at += len(piece)
                if at in boundaries and at >= start - begin + len(replacement):
                    stop = at
                    break
            if stop is None and final:
                stop = len(everything)
                edges[stop] = len(self.slots) - 1
            if stop is not None:
                break
            text, covered, last = everything, covered + len(ahead), more - 1
        for k in range(first + 1, edges[stop] + 1):
            if self.slots[k]:
                self._set(k, [])
        self._set(first, pieces)
        self.reencoded += len(pieces)
        if len(pieces) > SLOT:
            self._lay([p for s in self.slots for p in s], [n for _, n in self.leaves()])


def _recount(ranks, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = SegmentTree(encoder, text or "")
                before, leaves = tree.tokens, sum(map(bool, tree.slots))
                for e in edits or []:
                    if e is not None and e["start"] is not None:
                        tree.edit(e["start"], e["length"] or 0, e["replacement"] or "")
                rows.append((before, leaves, tree.tokens, tree.characters, tree.reencoded))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], schema=out)

    return run


def recounted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
              vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: ``id, n_tokens, n_leaves, n_tokens_edited, n_chars_edited, n_reencoded``.

    ``edits_col``: an array of structs ``start, length, replacement`` in code points
    of the text as the edits before have left it; ranges are cut to the text.  Null
    and empty texts have no tokens; null edits, or edits without a start, change
    nothing.  Repeated rows count each; an empty table gives no rows; other columns
    are ignored."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    edits = F.col("edits").cast("array<struct<start:bigint,length:bigint,replacement:string>>")
    rows = numbered(docs).select(*(place(docs, c).alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (edits_col, "edits"))))
    rows = rows.select("id", "text", edits.alias("edits"))
    out = StructType.fromDDL(f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, n_leaves bigint, n_tokens_edited bigint, n_chars_edited bigint, n_reencoded bigint")
    return rows.mapInArrow(_recount(ranks, to_arrow_schema(out)), out)


def _keep(ranks, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            texts, kept, numbers = [], [], []
            for text, edits, leaves in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                tree = SegmentTree(encoder, text or "", None if leaves is None else [(x["length"], x["tokens"]) for x in leaves])
                for e in edits or []:
                    if e is not None and e["start"] is not None:
                        tree.edit(e["start"], e["length"] or 0, e["replacement"] or "")
                texts.append(tree.text())
                kept.append([{"length": a, "tokens": b} for a, b in tree.leaves()])
                numbers.append((tree.tokens, tree.characters, tree.reencoded))
            columns = zip(*numbers) if numbers else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, out.field("text").type), pa.array(kept, out.field("leaves").type),
                                              *(pa.array(c, pa.int64()) for c in columns)], schema=out)

    return run


def kept_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None,
               leaves_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: ``id, text, leaves, n_tokens, n_chars, n_reencoded``, the
    tree as a table after its edits (see :func:`recounted`), for the caller to write.

    A later call takes such a table with new edits joined to it and ``leaves_col="leaves"``,
    ``id_col="id"``: its texts are not split or encoded again but where edits need it.
    Null leaves are built from the text.  Null texts become empty ones."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    typed = lambda name, kind: (F.lit(None) if name is None else place(docs, name)).cast(kind)
    rows = numbered(docs).select(place(docs, id_col).alias("id"), place(docs, text_col).alias("text"),
                       typed(edits_col, "array<struct<start:bigint,length:bigint,replacement:string>>").alias("edits"),
                       typed(leaves_col, "array<struct<length:bigint,tokens:bigint>>").alias("leaves"))
    out = StructType.fromDDL(f"id {rows.schema['id'].dataType.simpleString()}, text string, leaves array<struct<length:bigint,tokens:bigint>>, n_tokens bigint, n_chars bigint, n_reencoded bigint")
    return rows.mapInArrow(_keep(ranks, to_arrow_schema(out)), out)


def sample_edits(text: str = "text"):
    """Edits of every text for the query: a deletion at a quarter, an insertion at
    the middle, a replacement at three quarters of its length."""
    n = F.length(text)
    one = lambda share, length, new: F.struct(
        F.floor(n * share).alias("start"), F.lit(length).cast("bigint").alias("length"), F.lit(new).alias("replacement"))
    return F.array(one(0.25, 12, ""), one(0.5, 0, " [edited] "), one(0.75, 5, "'re é\U0001f600 12"))

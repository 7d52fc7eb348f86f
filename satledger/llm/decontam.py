"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised items (words as symbols) is built per block of
items of bounded size and broadcast; training words stream through it, which
gives the longest match ending at each word.  A match of at least ``window``
words hits all its words; an item of fewer words hits when it occurs whole.

Words are hashed in vectorised passes.  A match cannot contain a pair of
neighbours that no item contains, so only maximal runs of known pairs stream
through the automaton; elsewhere the match length is below two.
"""
from __future__ import annotations

import functools
import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satledger.llm.common import arrow_text, as_before, small_batches, store, text_bytes, with_text
from satledger.llm.words import ALNUM, hashed_words

#: Bytes of item text in one automaton (a few hundred MB of states at most).
BLOCK_BYTES = 4 << 20
#: Ids of items are broadcast up to this number; beyond it they are joined.
BROADCAST_IDS = 500_000
#: Spans and keys that are broadcast with their rows; beyond it they are joined.
BROADCAST_HITS = 500_000
#: Words of ``ALNUM`` in bytes.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Suffix automaton of several sequences over integer symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, symbol: int) -> int:
        """The state of the sequence that ended in ``last`` and one more symbol."""
        q = self.next[last].get(symbol)
        if q is not None:  # known from an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new

    def add(self, symbols: list[int]) -> None:
        last = 0
        for s in symbols:
            last = self.extend(last, s)

    def step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest match that ends with ``symbol``."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        state = self.next[state].get(symbol, 0)
        return state, matched + 1 if state else 0


class Matcher:
    """The automaton of one block of items, its vocabulary and known word pairs."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        words = [h for _, h in items]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        coded = [np.searchsorted(self.vocabulary, h).tolist() for h in words]
        self.automaton = SuffixAutomaton()
        for c in coded:
            self.automaton.add(c)
        size = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * size + b for c in coded for a, b in zip(c, c[1:])], np.int64))
        self.shortest = min([window, *(len(c) for c in coded if c)])
        # items by the state of each window (the short items: of the whole item)
        self.full: dict[int, list[int]] = {}
        self.short: dict[int, list[int]] = {}
        for k, c in enumerate(coded):
            state = matched = 0
            for i, s in enumerate(c):
                state, matched = self.automaton.step(state, matched, s)
                if i + 1 >= window:
                    self._note(self.full, self.suffix_state(state, window), k)
            if c and len(c) < window:
                self._note(self.short, self.suffix_state(state, len(c)), k)
        self.short_length = {v: len(coded[ks[0]]) for v, ks in self.short.items()}
        sieve = np.zeros(1 << 16, bool)
        sieve[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.sieve = sieve

    @staticmethod
    def _note(table: dict[int, list[int]], state: int, item: int) -> None:
        known = table.setdefault(state, [])
        if not known or known[-1] != item:  # items come one after another
            known.append(item)

    def suffix_state(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` symbols of what ``state`` matches."""
        while self.automaton.length[self.automaton.link[state]] >= length:
            state = self.automaton.link[state]
        return state

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes; -1: in no item."""
        out = np.full(len(h), -1, np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.sieve[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            found = self.vocabulary[at] == h[maybe]
            out[maybe[found]] = at[found]
        return out

    def runs(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of known neighbours with room for the shortest window."""
        known = codes >= 0
        joined = known[:-1] & known[1:]
        if len(joined):
            inner = bounds[1:-1]
            inner = inner[(inner > 0) & (inner < len(codes))]
            joined[inner - 1] = False
            where = np.flatnonzero(joined)
            key = codes[where] * len(self.vocabulary) + codes[where + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
            joined[where] = self.pairs[at] == key if len(self.pairs) else False
        begin = known.copy()
        begin[1:] &= ~joined
        end = known.copy()
        end[:-1] &= ~joined
        first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = last - first >= self.shortest
        return first[long], last[long]

    def match(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges and items of one run of words."""
        a, state, matched, spans, items = self.automaton, 0, 0, [], set()
        for i, symbol in enumerate(codes):
            state, matched = a.step(state, matched, symbol)
            if matched >= self.window:
                spans.append((i + 1 - matched, i + 1))
                items.update(self.full[self.suffix_state(state, self.window)])
            if self.short:
                at = state
                while at > 0:
                    if at in self.short and matched >= self.short_length[at]:
                        spans.append((i + 1 - self.short_length[at], i + 1))
                        items.update(self.short[at])
                    at = a.link[at]
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(matcher, out: pa.Schema, carried: int):
    """Each row's number of words, and the spans and keys of items' texts that one block hits."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        for batch in batches:
            raw, at = arrow_text(batch.column(carried - 1))
            counts, spans, items = [], [], []
            for lo, hi, h, bounds in hashed_words(raw, at, ALNUM):
                counts += np.diff(bounds).tolist()
                own: list[list] = [[] for _ in range(hi - lo)]
                named: list[set] = [set() for _ in range(hi - lo)]
                codes = m.codes(h)
                first, last = m.runs(codes, bounds)
                for a, b, d in zip(first.tolist(), last.tolist(), (np.searchsorted(bounds, first, side="right") - 1).tolist()):
                    found, which = m.match(codes[a:b].tolist())
                    start = a - int(bounds[d])
                    own[d] += [(start + x, start + y) for x, y in found]
                    named[d] |= which
                spans += own
                items += [[m.names[k] for k in s] for s in named]
            rows = [[{"first": a, "last": b} for a, b in _merged(s)] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], pa.array(counts, pa.int64()), pa.array(rows, out.field("spans").type),
                 pa.array([sorted(set(x)) for x in items], out.field("keys").type)], schema=out)

    return run


def _merge_hits(out: pa.Schema):
    """One merged list of spans and one of keys for each row that blocks have hit."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"first": a, "last": b} for a, b in _merged([tuple(x.values()) for x in row])] for row in batch.column(1).to_pylist()]
            keys = [sorted(set(row)) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, out.types[1]), pa.array(keys, out.types[2])], schema=out)

    return run


def keyed_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, text, key`` of the items with words: normalised texts and their hashes."""
    lower = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("text")).where("text <> ''")
    return items.withColumn("key", F.md5("text"))


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Key and text of the distinct texts, one block on the driver at a time: running
    sums cut each bucket of them at ``block_bytes``; a longer text is a block of its own."""
    texts = store(items.select("key", "text").dropDuplicates(["key"]), "decontam-texts")
    buckets = max(1, -(-text_bytes(texts) // block_bytes))
    size = F.octet_length("text").cast("bigint")
    upto = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = max(1, block_bytes // 2)
    # texts up to half a block share one where they end in the same half block
    part = F.when(size > half, F.concat(F.lit("x"), "key")).otherwise(
        F.floor((F.sum(F.when(size > half, 0).otherwise(size)).over(upto) - 1) / half).cast("string"))
    placed = store(texts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).withColumn("part", part), "decontam-blocks")
    for b in placed.select("bucket", "part").distinct().sort("bucket", "part").collect():
        rows = placed.where((F.col("bucket") == b["bucket"]) & (F.col("part") == b["part"])).select("key", "text").collect()
        yield [(r["key"], r["text"].encode()) for r in rows]


def _hits(docs: DataFrame, items: DataFrame, window: int, text_col: str, block_bytes: int) -> DataFrame:
    """``doc, text, n_words, spans, keys``; the keys are those of the items' texts.

    A task holds the automaton of one block at a time: the first block's hits come with
    the rows, each further block is a pass of its own over the texts, which writes its
    hits, and these are joined to their rows at the end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    small_batches(spark)
    out = with_text(docs, text_col)
    schema = StructType(out.schema.fields + StructType.fromDDL(
        "n_words bigint, spans array<struct<first:bigint,last:bigint>>, keys array<string>").fields)

    def scan(rows: DataFrame, block: list[tuple[str, bytes]]) -> DataFrame:
        """``rows`` (a column, then the text) with their words and the block's hits."""
        hashed = []
        for name, text in block:
            raw = np.frombuffer(text, np.uint8)
            found = [h for _, _, h, _ in hashed_words(raw, np.array([0, len(raw)]), ALNUM)]
            hashed.append((name, np.concatenate(found) if found else np.zeros(0, np.uint64)))
        matcher = spark.sparkContext.broadcast(Matcher(hashed, window))
        made = StructType(rows.schema.fields[:2] + schema.fields[2:])
        return rows.mapInArrow(_scan(matcher, to_arrow_schema(made), 2), made)

    blocks = item_blocks(items, block_bytes)
    out = scan(out, next(blocks, []))  # without items: an empty block counts the words
    second = next(blocks, None)
    if second is None:
        return out
    out = store(out.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    found = [out.select("row", "spans", "keys")]
    for block in itertools.chain([second], blocks):
        hits = scan(out.select("row", "text"), block).select("row", "spans", "keys").where(F.size("spans") > 0)
        found.append(store(hits, "decontam-block-hits"))
    some = functools.reduce(DataFrame.unionByName, found).where(F.size("spans") > 0)
    all_hits = some.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("keys")).alias("keys"))
    merged = StructType.fromDDL("row bigint, spans array<struct<first:bigint,last:bigint>>, keys array<string>")
    all_hits = store(all_hits.mapInArrow(_merge_hits(to_arrow_schema(merged)), merged), "decontam-merged")
    size = all_hits.agg(F.sum(F.size("spans") + F.size("keys"))).first()[0] or 0
    rows = out.drop("spans", "keys").join(F.broadcast(all_hits) if size <= BROADCAST_HITS else all_hits, "row", "left")
    return rows.select("doc", "text", "n_words", *(F.coalesce(c, F.array().cast(schema[c].dataType)).alias(c) for c in ("spans", "keys")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc`` (a struct of the other columns), ``text, n_words, spans, items``.

    ``spans``: merged ranges ``first, last`` (exclusive) of hit words; ``items``:
    ids, as strings, of the items with an occurring window (a null id hits but has
    no name; a repeated id counts once).  Null or empty texts have no words; items
    without words match nothing.  Words are lower-cased (A-Z) runs of ASCII letters
    and digits and of characters beyond ASCII; texts of any length are matched whole,
    repeated rows each.  Only distinct normalised texts of
    items pass through the driver, a block at a time; their ids are joined to the hits.  Empty tables give
    no rows or no hits; columns of any names travel in ``doc``."""
    items = store(keyed_items(benchmark, item_col, item_text_col), "decontam-items")
    # written: row numbers are drawn once
    found = store(_hits(docs, items, window, text_col, block_bytes).withColumn("row", F.monotonically_increasing_id()), "decontam-hits")
    names = items.groupBy("key").agg(F.collect_set("item").alias("ids"))
    hits = found.select("row", F.explode("keys").alias("key"))
    named = hits.join(F.broadcast(names) if items.count() <= BROADCAST_IDS else names, "key").groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    return found.join(named, "row", "left").select(
        "doc", "text", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(spans: str = "spans") -> Column:
    """Number of words inside the merged ranges."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"])


def _covered(max_coverage: float) -> Column:
    return hit_words() <= F.col("n_words") * F.lit(max_coverage)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.0, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows of which more than ``max_coverage`` of the words are hit.

    Nulls, empty and very long texts, repeated rows and items as in :func:`contamination`;
    rows without words stay.  An empty table gives no rows, an empty benchmark leaves all.
    Columns keep their names, whatever they are."""
    found = _hits(docs, keyed_items(benchmark, item_col, item_text_col), window, text_col, block_bytes)
    clean = found.where(_covered(max_coverage))
    return as_before(clean, docs.columns, text_col)


def _cut(out: pa.Schema, max_words: int):
    """Each text without its spans of more than ``max_words`` words."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                long = [(s["first"], s["last"]) for s in spans if s["last"] - s["first"] > max_words]
                if long:
                    raw = text.encode()
                    places = [m.span() for m in _WORD.finditer(raw)]
                    kept, at = [], 0
                    for first, last in long:
                        kept.append(raw[at:places[first][0]])
                        at = places[last - 1][1]
                    text = b"".join([*kept, raw[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, out.types[1])], schema=out)

    return run


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 0, max_coverage: float = 1.0,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every merged span of more than ``max_words`` words cut from the text
    (from its first word to its last; what stands around stays), without the rows of
    which more than ``max_coverage`` of the words were hit.  Words that only become
    neighbours by a cut are not looked at again.  Null texts stay null; all else as in
    :func:`decontaminated`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    found = _hits(docs, keyed_items(benchmark, item_col, item_text_col), window, text_col, block_bytes)
    rows = found.where(_covered(max_coverage)).select("doc", "text", "n_words", "spans")
    out = StructType(rows.schema.fields[:2])
    cut = rows.mapInArrow(_cut(to_arrow_schema(out), max_words), out)
    return as_before(cut, docs.columns, text_col)

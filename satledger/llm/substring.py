"""Removal of byte strings that repeat anywhere in the corpus.

A byte goes when a ``LENGTH``-byte string that covers it also starts elsewhere.

1. Every window of ``LENGTH`` bytes is named by its anchor: its least-hashed
   ``GRAM``-byte string, the leftmost of equals.  Equal windows have the same
   anchor at the same offset.  One anchor serves a run of windows; the bytes that
   these cover are its context.
2. Anchors meet by hash.  Equal contexts repeat all their windows and need no
   more.  A context whose anchor occurs elsewhere, but which itself does not, may
   repeat some windows: it is resolved, against one of each of the others.
3. Resolving is a column-wise suffix sort of the collection of contexts, aligned
   at their anchors: from the last column to the first one symbol per context is
   inserted, which updates the order of the suffixes (its symbols in order are the
   collection's Burrows-Wheeler transform) and the common prefixes of neighbours.
   A window repeats when its suffix shares ``LENGTH`` symbols with a neighbour.
   Collections are runs of shuffled partitions, read in sequence; the full
   transform of the corpus, with one round per symbol of its longest document, is
   not built.
4. The windows of an anchor with more than ``HOT`` contexts are counted by name, a
   128-bit hash: first in each task, which sends a window that it has seen twice as
   its name only, then over all tasks.

Documents of equal text are known by digest; such text repeats as a whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger.llm.common import arrow_bytes, arrow_text, keyed, small_batches, spread, store, text_bytes
from satledger.llm.words import BLOCK, Alphabet, _power_table, mix

LENGTH = 200
GRAM = 64
#: Contexts of one anchor that one task resolves at most.
HOT = 500
#: Contexts that are sorted together.
COLLECTION = 20_000
#: Anchors that a task holds before it sends them on.
CHUNK = 1 << 18
#: Different contexts of one anchor in a chunk from which on they are known to need resolving.
CHUNK_HOT = 64
#: Bytes of text per partition of anchors.
PART_BYTES = 16 << 20
#: Lists of what to resolve or remove are broadcast up to this size; beyond it they are joined.
BROADCAST_BYTES = 64 << 20

_BYTES = Alphabet(lambda b: True, lower=False)
_KEY = np.dtype("V16")
#: Bits of a position in a block.
_BITS = np.uint64(BLOCK.bit_length())


def mark(first, width) -> np.ndarray:
    """A run of ``width + 1`` window starts as one number."""
    return np.asarray(first, np.uint64) << np.uint64(8) | np.asarray(width, np.uint64)


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int):
    """Anchors of all windows inside the documents ``first`` to ``last`` of a block
    of bytes: document, anchor position, first and last window start (all in the
    block), hash of the anchor and of its context."""
    n = len(data)
    none = np.zeros(0, np.int64)
    starts = np.maximum(last - length + 1, first) - first  # windows of each document
    if not starts.sum():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = _power_table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES.values[data] * up[:n], out=sums[1:])
    wide = length - gram + 1
    grams = n - gram + 1
    hashed = mix((sums[gram:] - sums[:grams]) * down[:grams])
    # hash and position in one number: the least is the leftmost of the least
    ranked = hashed >> _BITS << _BITS | np.arange(grams, dtype=np.uint64)
    padded = np.concatenate((ranked, np.full((-grams) % wide, ~np.uint64(0)))).reshape(-1, wide)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = grams - wide + 1
    least = np.minimum(behind[:windows], ahead[wide - 1:wide - 1 + windows])
    place = (least & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(first)), starts)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts) + first[doc]
    place = place[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(begin)) - 1
    low, high = begin[at], begin[end]
    context = mix((sums[high + length] - sums[low]) * down[low]) + (place[at] - low).astype(np.uint64) * np.uint64(512) + (high - low).astype(np.uint64)
    return doc[at], place[at], low, high, hashed[place[at]], mix(context)


def document_anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> Iterator[tuple]:
    """Runs of documents: the first one's number and its anchors, positions counted
    in the document.  A long document is read in overlapping blocks: a run of
    windows that a block's end cuts is two anchors at one position."""
    n, d = len(at) - 1, 0
    while d < n:
        end = max(d + 1, int(np.searchsorted(at, at[d] + BLOCK, side="right")) - 1)
        lo, hi = int(at[d]), int(at[end])
        if hi - lo <= BLOCK:
            first = at[d:end] - lo
            doc, place, low, high, h, c = anchors(raw[lo:hi], first, at[d + 1:end + 1] - lo, length, gram)
            yield d, doc, place - first[doc], low - first[doc], high - first[doc], h, c
        else:
            step = BLOCK - length + 1
            for a in range(lo, max(lo + 1, hi - length + 1), step):
                b = min(hi, a + BLOCK)
                doc, place, low, high, h, c = anchors(raw[a:b], np.array([0]), np.array([b - a]), length, gram)
                yield d, doc, place + (a - lo), low + (a - lo), high + (a - lo), h, c
        d = end


_PACKED = "part int, home int, kind int, anchor binary, context binary, who binary, marks binary, keys binary"
_PACKED_ARROW = pa.schema([(n, pa.int32()) for n in ("part", "home", "kind")] + [(n, pa.binary()) for n in ("anchor", "context", "who", "marks", "keys")])
#: Kinds of packed rows: anchors for their home; anchors known to be full; known to need resolving.
_MEET, _FULL, _SEND = 0, 1, 2


def _pack(part: int, home: int, kind: int, anchor, context, flags, who, marks, keys: np.ndarray) -> pa.RecordBatch:
    """The anchors go as 32 bits within their home partition: a false meeting only
    resolves contexts in vain."""
    used, who = np.unique(who, return_inverse=True)
    met = kind == _MEET
    cells = [anchor.tobytes() if met else b"", context.tobytes() if met else b"",
             (who.astype(np.uint32) << np.uint32(2) | flags.astype(np.uint32)).tobytes(), marks.tobytes(), keys[used].tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (part, home, kind)] + [pa.array([c], pa.binary()) for c in cells],
                                      schema=_PACKED_ARROW)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _sign(parts: int, length: int, gram: int):
    """Packed anchors of the distinct texts of each chunk.  Of equal contexts the
    first goes to the anchor's home partition, the others are known to be full;
    of an anchor with very many contexts one goes, the others are known to need
    resolving: a hot anchor sends few rows from any task."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held, keys, seen, turn = [], [], set(), 0

        def flush():
            nonlocal turn
            h, c, who, at, low, high = (np.concatenate(x) for x in zip(*held))
            names = np.frombuffer(b"".join(keys), _KEY)
            marks = mark(low, high - low) << np.uint64(8) | (at - low).astype(np.uint64)
            home = (h % np.uint64(parts)).astype(np.int64)
            h = (h // np.uint64(parts)).astype(np.uint32)
            order = np.lexsort((c, h, home))
            h, c, who, marks, home = h[order], c[order], who[order], marks[order], home[order]
            group, same = np.cumsum(_runs(home, h)) - 1, _runs(home, h, c)
            count = np.bincount(np.cumsum(same) - 1)[np.cumsum(same) - 1]
            hot = np.bincount(group, same)[group] > CHUNK_HOT
            leads = _runs(group)
            flags = (count > 1) * 1 + hot * 2
            meet = np.flatnonzero(same & (~hot | leads))
            cuts = np.flatnonzero(np.diff(home[meet], prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(meet)]):
                r, here = meet[a:b], int(home[meet[a]])
                yield _pack(here, here, _MEET, h[r], c[r], flags[r], who[r], marks[r], names)
            for kind, pick in ((_FULL, ~same | (hot & (count > 1))), (_SEND, same & hot)):
                rows = np.flatnonzero(pick)
                rows = rows[np.argsort(who[rows], kind="stable")]
                for a in range(0, len(rows), 1 << 15):
                    r = rows[a:a + (1 << 15)]
                    turn += 1
                    yield _pack((int(c[r[0]] >> np.uint64(40)) + turn) % parts, -1, kind, h[r], c[r], flags[r], who[r], marks[r], names)

        total = 0
        for batch in batches:
            raw, at = arrow_text(batch.column(1))
            fresh, names = [], batch.column(0).to_pylist()
            for i, k in enumerate(names):
                if k not in seen and at[i + 1] - at[i] >= length:
                    seen.add(k)
                    fresh.append(i)
            spot = {i: len(keys) + j for j, i in enumerate(fresh)}
            keys += [names[i] for i in fresh]
            number = np.array([spot.get(i, -1) for i in range(len(names))], np.int64)
            for d, doc, place, low, high, h, c in document_anchors(raw, at, length, gram):
                who = number[doc + d]
                own = who >= 0
                held.append((h[own], c[own], who[own], place[own], low[own], high[own]))
                total += int(own.sum())
            if total >= CHUNK:
                yield from flush()
                held, keys, seen, total = [], [], set(), 0
        if total:
            yield from flush()

    return run


_MARKED = "key binary, send boolean, marks binary"
_MARKED_ARROW = pa.schema([("key", pa.binary()), ("send", pa.bool_()), ("marks", pa.binary())])


def _by_text(who, keys, marks, send) -> Iterator[pa.RecordBatch]:
    """A row per text and kind of mark; a mark that two chunks found counts once."""
    if not len(who):
        return
    names, of = np.unique(keys, return_inverse=True)
    of = of[who] * 2 + send
    order = np.lexsort((marks, of))
    of, marks = of[order], marks[order]
    fresh = _runs(of, marks)
    of, marks = of[fresh], marks[fresh]
    cuts = np.flatnonzero(_runs(of))
    data, ends = marks.tobytes(), np.append(cuts[1:], len(of))
    rows = [data[8 * a:8 * b] for a, b in zip(cuts.tolist(), ends.tolist())]
    for i in range(0, len(rows), 50_000):
        some = of[cuts[i:i + 50_000]]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in names[some >> 1]], pa.binary()), pa.array(some & 1 == 1),
                                          pa.array(rows[i:i + 50_000], pa.binary())], schema=_MARKED_ARROW)


def _meet(batches) -> Iterator[pa.RecordBatch]:
    """Marks of the anchors of a home partition: full, or to be resolved."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, home, kind, anchor, context, who, marks, keys in zip(*(batch.column(i).to_pylist() for i in range(8))):
            who, marks, keys = np.frombuffer(who, np.uint32), np.frombuffer(marks, np.uint64), np.frombuffer(keys, _KEY)
            if kind != _MEET:
                yield from _by_text(who >> 2, keys, marks, np.full(len(marks), kind == _SEND))
            else:
                held.setdefault(home, []).append((np.frombuffer(anchor, np.uint32), np.frombuffer(context, np.uint64), who >> 2, who & 3, marks, keys))
    for parts in held.values():
        start = np.cumsum([0, *(len(p[5]) for p in parts)])
        h, c, flags, marks, keys = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4, 5))
        who = np.concatenate([p[2].astype(np.int64) + s for p, s in zip(parts, start)])
        order = np.lexsort((c, h))
        h, c, flags, marks, who = h[order], c[order], flags[order], marks[order], who[order]
        group, first = np.cumsum(_runs(h)) - 1, _runs(h, c)
        same = np.cumsum(first) - 1
        full = (np.bincount(same)[same] > 1) | (np.bincount(same, flags & 1)[same] > 0)
        mixed = (np.bincount(group, first)[group] > 1) | (np.bincount(group, flags & 2)[group] > 0)
        open_ = np.bincount(group, ~full | (flags & 2 > 0))[group] > 0
        send = mixed & open_ & (first | ~full)
        both = np.concatenate((np.flatnonzero(full), np.flatnonzero(send)))
        kinds = np.repeat([False, True], [int(full.sum()), int(send.sum())])
        yield from _by_text(who[both], keys, marks[both], kinds)


_CONTEXT = "anchor bigint, n int, keys binary, at binary, low binary, high binary, context binary"
_CONTEXT_ARROW = pa.schema([("anchor", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("keys", "at", "low", "high", "context"))])


def _packed_contexts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Contexts (anchor, key, position, offset of the anchor, further windows, bytes) as
    one row per anchor: a hot anchor makes few rows in any task."""
    rows.sort(key=lambda r: r[0])
    cuts = [i for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]]
    packed = []
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        anchor, keys, at, low, high, texts = zip(*rows[a:b])
        packed.append((anchor[0], b - a, b"".join(keys), np.array(at, np.int64).tobytes(), np.array(low, np.int32).tobytes(),
                       np.array(high, np.int32).tobytes(), b"".join(texts)))
    if packed:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed), _CONTEXT_ARROW.types)], schema=_CONTEXT_ARROW)


def _unpacked(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    for anchor, n, keys, at, low, high, texts in zip(*(batch.column(i).to_pylist() for i in range(7))):
        high = np.frombuffer(high, np.int32)
        ends = np.cumsum(high + length).tolist()
        for i, (p, q, w, a, b) in enumerate(zip(np.frombuffer(at, np.int64).tolist(), np.frombuffer(low, np.int32).tolist(), high.tolist(), [0, *ends], ends)):
            yield anchor, keys[16 * i:16 * i + 16], p, q, w, texts[a:b]


def _cut(length: int, gram: int):
    """The contexts to be resolved, of each text once per task."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rows: list[tuple] = []
        for batch in batches:
            for key, text, marks in zip(batch.column(0).to_pylist(), arrow_bytes(batch.column(1)), batch.column(2).to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                for m in np.unique(np.frombuffer(b"".join(marks), np.uint64)).tolist():
                    first, width, low = m >> 16, m >> 8 & 255, m & 255
                    rows.append((xxhash.xxh3_64_intdigest(text[first + low:first + low + gram]) >> 1, key, first + low, low, width, text[first:first + width + length]))
                    if len(rows) >= COLLECTION:
                        yield from _packed_contexts(rows)
                        rows = []
            if len(seen) > 1_000_000:
                seen = set()
        yield from _packed_contexts(rows)

    return run


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values[first:last + 1]`` for each pair, by doubling."""
    out = values[first]
    span = last - first + 1
    level, table = 1, values
    while True:
        pick = (span >= level) & (span < 2 * level)
        if pick.any():
            out[pick] = np.minimum(table[first[pick]], table[last[pick] - level + 1])
        if 2 * level > span.max(initial=0):
            return out
        table = np.minimum(table[:-level], table[level:])
        level *= 2


def repeated_starts(contexts: list[bytes], lows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which windows repeat within the collection: a matrix, a row for each context,
    a column for each window start from ``length - gram`` before the anchor to the
    anchor.  Round by round one symbol of every context is inserted."""
    reach = length - gram
    n, width = len(contexts), reach + length
    symbols = np.zeros((width, n), np.uint16)  # 0: outside the context
    for i, (text, low) in enumerate(zip(contexts, lows.tolist())):
        symbols[reach - low:reach - low + len(text), i] = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
    order, common = np.arange(n), np.zeros(n, np.uint16)
    out = np.zeros((n, reach + 1), bool)
    for column in range(width - 1, -1, -1):
        transform = symbols[column][order]
        move = np.argsort(transform, kind="stable")
        transform = transform[move]
        joined = np.flatnonzero((transform[1:] == transform[:-1]) & (transform[1:] > 0)) + 1
        new = np.zeros(n, np.uint16)
        if len(joined):
            new[joined] = _range_least(common, move[joined - 1] + 1, move[joined]) + 1
        order, common = order[move], new
        if column <= reach:
            long = common >= length
            long[:-1] |= long[1:]
            out[order[long], column] = True
    return out


_FOUND = "key binary, marks binary"
_FOUND_ARROW = pa.schema([("key", pa.binary()), ("marks", pa.binary())])


def _found(who: np.ndarray, start: np.ndarray, keys) -> Iterator[pa.RecordBatch]:
    """Marks of window starts, in order of their text ``who``: a run of neighbouring
    starts becomes one mark."""
    if not len(who):
        return
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)
    run = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    new |= (np.arange(len(who)) - at[run]) % 256 == 0  # a mark holds so many
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(who)) - 1
    marks, who = mark(start[a], start[b] - start[a]) << np.uint64(8), who[a]
    cuts = np.flatnonzero(np.diff(who, prepend=-1))
    data, ends = marks.tobytes(), [*cuts[1:].tolist(), len(marks)]
    rows = [(keys[w], data[8 * i:8 * j]) for w, i, j in zip(who[cuts].tolist(), cuts.tolist(), ends)]
    for i in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows[i:i + 20_000])], schema=_FOUND_ARROW)


def _resolve(length: int, gram: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def sort(part):
            at, low = np.array([r[2] for r in part]), np.array([r[3] for r in part])
            hit = repeated_starts([r[5] for r in part], low, length, gram)
            where, start = np.nonzero(hit)
            yield from _found(where, at[where] - (length - gram) + start, [r[1] for r in part])

        for batch in batches:  # in order of the anchor: a collection ends with a group
            for row in _unpacked(batch, length):
                if len(rows) >= COLLECTION and row[0] != rows[-1][0]:
                    yield from sort(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from sort(rows)

    return run


_WINDOWS = "part int, known binary, once binary, who binary, start binary, keys binary"
_WINDOWS_ARROW = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("known", "once", "who", "start", "keys"))])


def _window_row(part: int, known, once, who, start, keys: np.ndarray) -> pa.RecordBatch:
    used, who = np.unique(who, return_inverse=True)
    cells = [known.tobytes(), once.tobytes(), who.astype(np.uint32).tobytes(), start.tobytes(), keys[used].tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], schema=_WINDOWS_ARROW)


def _name_windows(parts: int, length: int):
    """Names (128-bit hashes) of the windows of hot anchors, counted in the task: of
    windows that occur twice in it the name goes once, their places are known already
    to repeat; of the others the name goes with its place."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        names, who, starts, keys, turn = [], [], [], [], 0

        def flush():
            nonlocal turn
            name = np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)
            texts, owner = np.unique(np.frombuffer(b"".join(keys), _KEY), return_inverse=True)
            place, start = owner[np.array(who)], np.array(starts, np.int64)
            home = (name[:, 0] % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((start, place, name[:, 1], name[:, 0], home))
            name, place, start, home = name[order], place[order], start[order], home[order]
            # an occurrence that two contexts show counts once
            own = _runs(name[:, 0], name[:, 1], place, start)
            name, place, start, home = name[own], place[own], start[own], home[own]
            first = _runs(name[:, 0], name[:, 1])
            group = np.cumsum(first) - 1
            again = np.bincount(group)[group] > 1
            lead = np.flatnonzero(first)
            cuts = np.flatnonzero(np.diff(home[lead], prepend=-1))
            for a, b in zip(lead[cuts].tolist(), [*lead[cuts[1:]].tolist(), len(home)]):
                known, once = again[a:b] & first[a:b], ~again[a:b]
                yield _window_row(int(home[a]), name[a:b][known], name[a:b][once], place[a:b][once], start[a:b][once], texts)
            rows = np.flatnonzero(again)
            rows = rows[np.argsort(place[rows], kind="stable")]
            for a in range(0, len(rows), 1 << 15):
                r = rows[a:a + (1 << 15)]
                turn += 1
                yield _window_row(int(name[r[0], 1] % np.uint64(parts) + np.uint64(turn)) % parts, name[:0], name[:0], place[r], start[r], texts)

        for batch in batches:
            for anchor, key, at, low, high, text in _unpacked(batch, length):
                names.extend(xxhash.xxh3_128_digest(text[i:i + length]) for i in range(high + 1))
                who.extend([len(keys)] * (high + 1))
                starts.extend(range(at - low, at - low + high + 1))
                keys.append(key)
                if len(names) >= CHUNK:
                    yield from flush()
                    names, who, starts, keys = [], [], [], []
        if names:
            yield from flush()

    return run


def _meet_windows(batches) -> Iterator[pa.RecordBatch]:
    """Marks of the windows whose name occurs twice."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, known, once, who, start, keys in zip(*(batch.column(i).to_pylist() for i in range(6))):
            who, start = np.frombuffer(who, np.uint32).astype(np.int64), np.frombuffer(start, np.int64)
            if not known and not once:
                order = np.lexsort((start, who))
                yield from _found(who[order], start[order], [keys[16 * i:16 * i + 16] for i in range(len(keys) // 16)])
            else:
                held.setdefault(part, []).append((known, once, who, start, keys))
    for parts in held.values():
        texts, owner = np.unique(np.frombuffer(b"".join(p[4] for p in parts), _KEY), return_inverse=True)
        shift = np.cumsum([0, *(len(p[4]) // 16 for p in parts)])
        place = owner[np.concatenate([p[2] + s for p, s in zip(parts, shift)])]
        start = np.concatenate([p[3] for p in parts])
        name = np.frombuffer(b"".join([*(p[1] for p in parts), *(p[0] for p in parts)]), np.uint64).reshape(-1, 2)
        known = np.arange(len(name)) >= len(place)
        # the places of known names have their marks already: each counts as a place of its own
        place = np.concatenate((place, np.full(known.sum(), -1)))
        start = np.concatenate((start, np.arange(known.sum())))
        order = np.lexsort((start, place, name[:, 1], name[:, 0]))
        name, place, start, known = name[order], place[order], start[order], known[order]
        own = _runs(name[:, 0], name[:, 1], place, start)
        name, place, start, known = name[own], place[own], start[own], known[own]
        group = np.cumsum(_runs(name[:, 0], name[:, 1])) - 1
        rows = np.flatnonzero((np.bincount(group, 1 + known)[group] > 1) & ~known)
        rows = rows[np.lexsort((start[rows], place[rows]))]
        yield from _found(place[rows], start[rows], [t.tobytes() for t in texts])


def spans_of(marks: list[bytes], length: int) -> list[tuple[int, int]]:
    """Merged byte ranges of marked window starts."""
    all_ = np.frombuffer(b"".join(marks), np.uint64)
    first = (all_ >> np.uint64(16)).astype(np.int64)
    last = first + (all_ >> np.uint64(8) & np.uint64(255)).astype(np.int64) + length
    order = np.argsort(first)
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(new)
    return list(zip(first[at].tolist(), last[np.append(at[1:], len(first)) - 1].tolist()))


def _remove(length: int, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, copied, marks in zip(arrow_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans = [(0, len(text))] if copied and len(text) >= length else spans_of(marks, length) if marks else []
                ends = [0, *(e for _, e in spans)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(text)])) if spans else text)
                sizes.append(len(text))
                removed.append([{"first": a, "last": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, out.types[2]), pa.array(kept, pa.binary())], schema=out)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                    hot: int = HOT) -> DataFrame:
    """One row per input row: ``id, n_bytes, removed`` (merged ranges ``first, last``,
    exclusive, in bytes of the UTF-8 text) and ``kept``, the bytes outside them.

    Null counts as empty; texts under ``length`` bytes lose nothing; repeated rows are
    copies, so all of them lose everything.  ``length - gram`` is at most 255.  Empty
    tables give no rows; other columns are ignored."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    texts = rows.select(key.alias("key"), "text").where(F.octet_length("text") >= length)
    parts = spread(docs, text_bytes(texts), PART_BYTES)
    copies = store(texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeat-copies")
    signed = texts.mapInArrow(_sign(parts, length, gram), _PACKED)
    marked = store(signed.repartitionById(parts, "part").mapInArrow(_meet, _MARKED), "repeat-marks")

    sends = marked.where("send").groupBy("key").agg(F.collect_list("marks").alias("marks"))
    contexts = store(_with(texts, sends).mapInArrow(_cut(length, gram), _CONTEXT), "repeat-contexts")
    counts = contexts.groupBy("anchor").agg(F.sum("n").alias("n"))
    crowded = store(counts.where(F.col("n") > hot).select("anchor"), "repeat-hot")
    found = []
    if crowded.isEmpty():
        few = contexts
    else:  # a row of contexts per task and hot anchor: their windows are counted by name
        few = contexts.join(crowded, "anchor", "left_anti")
        named = contexts.join(crowded, "anchor", "left_semi").select(*contexts.columns).mapInArrow(_name_windows(parts, length), _WINDOWS)
        found.append(named.repartitionById(parts, "part").mapInArrow(_meet_windows, _FOUND))
    few = few.select(*contexts.columns).repartition(parts, "anchor").sortWithinPartitions("anchor")
    found.append(few.mapInArrow(_resolve(length, gram), _FOUND))

    partial = marked.where("not send").select("key", "marks")
    for more in found:
        partial = partial.unionByName(more)
    partial = partial.join(copies, "key", "left_anti").groupBy("key").agg(F.collect_list("marks").alias("marks"))
    gone = partial.select("key", F.lit(False).alias("copied"), "marks").unionByName(
        copies.select("key", F.lit(True).alias("copied"), F.array().cast("array<binary>").alias("marks")))
    gone = store(gone, "repeat-removals")
    out = StructType.fromDDL(f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, removed array<struct<first:bigint,last:bigint>>, kept binary")
    whole = _with(rows.select("id", "text", key.alias("key")), gone, "left")
    return whole.select("id", "text", "copied", "marks").mapInArrow(_remove(length, to_arrow_schema(out)), out)


def _with(texts: DataFrame, listed: DataFrame, how: str = "inner") -> DataFrame:
    """Join by ``key``; a list of small measured size is broadcast, a larger one is
    shuffled (equal texts make hot keys: adaptive execution splits them)."""
    listed = store(listed, "repeat-list")
    size = listed.agg(F.sum(F.lit(64) + F.aggregate("marks", F.lit(0), lambda n, m: n + F.octet_length(m)))).first()[0] or 0
    return texts.join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed, "key", how)

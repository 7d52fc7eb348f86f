"""Exact Jaccard join of word n-gram sets with PartEnum signatures.

1. Documents with equal sets are one node (a 128-bit hash of the set).
2. Nodes fall in size bands such that similar sets lie in one band or two
   neighbours.  In a band similar sets differ in at most ``k`` elements, so when
   the domain is cut into more than ``k / 2`` parts, one part differs in at most
   one element; each part is cut into three, and some two of these are equal.
   A node's signatures are the contents of two of three for every part, in its
   own band and the next: similar sets share one.
3. A node's sketch has a bit for each of a power of two of cells: whether an odd
   number of its elements falls there.  Two sets differ in at least as many elements
   as their sketches in bits (also once the longer one is folded to the shorter), so
   texts are compared only where the sketches leave a pair possible.
4. A group of two nodes is a pair.  A larger one is not paired up: all its members
   meet one hub, the most connected member (in later rounds several hubs of other
   components).  Two members that are linked with the hub need no comparison.
   Where the work is bounded, one task holds the sketches of all members of a hub
   against each other, and pairs that they leave possible are compared.
5. Of a wider hub, let D be a member's symmetric difference with it: two members
   differ by the symmetric difference of their Ds.  Either both are linked with the
   hub, or their Ds overlap, and by prefix filtering they share one of the first
   elements of both Ds.  Members that share such an element make the next groups,
   unless they were hubs, which have met all; groups of one component need no more.
   Where all members of such a hub fit one task, it counts what the first elements of
   their Ds share, and only pairs that share as many as similar sets must go on.  Of a
   larger hub, the groups of bounded size give the pairs that sizes and positions in
   both Ds leave possible, and larger groups start the next round.  Each group loses
   its hubs in each round, so the rounds end, and no link between two components is lost.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satledger.llm.common import arrow_text, discard, keyed, numbered, place, release, small_batches, spread, store, text_bytes
from satledger.llm.components import components
from satledger.llm.words import SPACED, hashed_words, mix, shingles

#: Signatures that a task holds before it sends them on.
CHUNK = 1 << 20
#: Bytes of text per partition of signatures.
PART_BYTES = 24 << 20
#: Members of a hub that one task compares at most, on average.
HUB_MEMBERS = 256
#: Node lists are broadcast up to this length (16 bytes each); beyond it they are joined.
BROADCAST_NODES = 500_000
#: Most hubs of a group in the first, second, and all later rounds, when few members are left.
SLOTS = (1, 4, 16)
#: Groups up to this size compare the pairs that positions and sizes allow; larger ones go on by hubs.
SMALL_GROUP = 1024
#: Members, and elements of their differences, up to which one task pairs up a hub's members.
LOCAL_MEMBERS = 1024
LOCAL_ELEMENTS = 1 << 21
#: Members of a hub from which on an element of their differences is frequent.
FREQUENT = 12
#: Members squared times bytes of a sketch up to which one task holds a hub's members against each other.
SKETCH_WORK = 1 << 33
#: Rows of a batch that are compared at once.
SLICE = 128
_SUBPARTS = 3


@dataclass(frozen=True)
class Scheme:
    """Shingle length and similarity in percent, with the bounds that follow."""
    words: int
    percent: int

    def differ(self, sizes: int) -> int:
        """Most elements in which similar sets of so many elements together differ."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def linked(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def most(self, size: int) -> int:
        """Most elements in which a set of this size differs from a similar one."""
        return self.differ(size + size * 100 // self.percent)

    def bands(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower ends, numbers of parts (0: equal sets only) and spare parts of the bands."""
        low, parts, spare, at = [], [], [], 1
        while at <= largest or len(low) < 2 or low[-2] <= largest:
            end = at * 100 // self.percent
            k = self.differ(2 * end)
            bad = k // 2
            cut = bad + 1
            empty = cut * _SUBPARTS * np.exp(-0.8 * at * (1 - 1 / _SUBPARTS) / cut)
            extra = int(np.ceil(empty + 3 * np.sqrt(empty)))
            low.append(at)
            parts.append(cut + extra if k else 0)
            spare.append(extra)
            at = end + 1
        return np.array(low), np.array(parts), np.array(spare)


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of documents: the first one's number and the sorted distinct shingles of each."""
    for lo, _, h, bounds in hashed_words(raw, at, SPACED):
        s, cut = shingles(h, bounds, words)
        yield lo, [distinct_sorted(s[a:b]) for a, b in itertools.pairwise(cut.tolist())]


def node_of(shingle_set: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingle_set.tobytes()) if len(shingle_set) else None


def sketch(shingle_set: np.ndarray) -> bytes:
    """Of a power of two of cells, at least two for an element, those with an odd number of elements."""
    cells = max(64, 1 << (2 * len(shingle_set) - 1).bit_length())
    cell = (mix(shingle_set ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(cells: bytes, nbytes: int) -> np.ndarray:
    """The sketch with so many bytes, a power of two not beyond its own, of the same set."""
    return np.bitwise_xor.reduce(np.frombuffer(cells, np.uint64).reshape(-1, nbytes // 8), axis=0)


def may_link(scheme: Scheme, size: int, cells: bytes, other_size: int, other: bytes) -> bool:
    """Whether sets of these sizes and sketches can be similar."""
    nbytes = min(len(cells), len(other))
    apart = np.bitwise_count(folded(cells, nbytes) ^ folded(other, nbytes)).sum(dtype=np.int64)
    return bool(apart <= scheme.differ(size + other_size))


def _nodes(words: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, part in shingle_sets(*arrow_text(batch.column(1)), words) for s in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([node_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                names=["id", "node", "n_shingles"])

    return run


def signatures(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets and the number of the set of each."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out_sig, out_set = [], []
    if not sizes.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, parts, spare = scheme.bands(int(sizes.max()))
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    values = mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    own = np.searchsorted(low, sizes, side="right") - 1
    for role in (0, 1):
        band = np.maximum(own, 0) + role
        cut = np.where(sizes > 0, parts[band], 0)
        cells_at = np.concatenate(([0], np.cumsum(cut * _SUBPARTS)))
        if not cells_at[-1]:
            continue
        used = cut[owner] > 0
        e, o = elements[used], owner[used]
        place = mix(e + band[o].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        cell = cells_at[o] + (place % (cut[o] * _SUBPARTS).astype(np.uint64)).astype(np.int64)
        content = np.zeros(int(cells_at[-1]), np.uint64)
        np.add.at(content, cell, values[used])
        filled = np.bincount(cell, minlength=len(content))
        content, filled = content.reshape(-1, _SUBPARTS), filled.reshape(-1, _SUBPARTS)
        pairs, members = content.sum(1, dtype=np.uint64)[:, None] - content, filled.sum(1)[:, None] - filled
        of = np.repeat(np.arange(len(sets)), cut)
        # a set with at most the spare number of parts with an empty pair has a full one among its equal parts
        bare = members == 0
        poor = np.bincount(of, bare.any(1), minlength=len(sets)) > spare[band]
        keep = ~bare | poor[of][:, None]
        position = np.arange(len(of)) - (cells_at[:-1] // _SUBPARTS)[of]
        label = mix((band[of] * np.int64(1 << 40) + position * 4).astype(np.uint64)[:, None] + np.arange(_SUBPARTS, dtype=np.uint64))
        sig = mix(pairs + label)
        out_sig.append(sig[keep])
        out_set.append(np.broadcast_to(of[:, None], keep.shape)[keep])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


_PACKED = "part int, home int, known boolean, low binary, high binary, who binary, nodes binary"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("home", pa.int32()), ("known", pa.bool_()), *((n, pa.binary()) for n in ("low", "high", "who", "nodes"))])


def _pack(part: int, home: int, known: bool, sig: np.ndarray, who: np.ndarray, nodes: list[bytes]) -> pa.RecordBatch:
    """Signatures of one home partition; the nodes they refer to, once each."""
    used, who = np.unique(who, return_inverse=True)
    short = np.uint16 if len(used) <= 1 << 16 else np.uint32
    cells = [sig.astype(np.uint32).tobytes(), (sig >> np.uint64(32)).astype(np.uint8).tobytes(), who.astype(short).tobytes(),
             b"".join(nodes[i] for i in used.tolist())]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([home], pa.int32()), pa.array([known]),
                                       *(pa.array([c], pa.binary()) for c in cells)], schema=_PACKED_ARROW)


def _sign(scheme: Scheme, parts: int):
    """Packed signatures of the distinct nodes of each chunk.  Of the nodes of a
    chunk that share a signature only the first goes to the signature's home
    partition; all go, as known to share it, to any."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        sig, who, nodes, seen, held, turn = [], [], [], set(), 0, 0

        def flush():
            nonlocal turn
            s, w = np.concatenate(sig), np.concatenate(who)
            whole, home = np.divmod(s, np.uint64(parts))
            s = home << np.uint64(40) | whole & np.uint64((1 << 40) - 1)
            order = np.argsort(s)
            s, w = s[order], w[order]
            home, first = (s >> np.uint64(40)).astype(np.int64), np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            s &= np.uint64((1 << 40) - 1)
            shared = ~first
            shared[:-1] |= ~first[1:]
            for known, pick in ((False, first), (True, shared)):
                at = np.flatnonzero(pick)
                cuts = np.flatnonzero(np.diff(home[at], prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                    here = int(home[at[a]])
                    turn += known
                    rows = at[a:b]
                    yield _pack((here + turn) % parts if known else here, here, known, s[rows], w[rows], nodes)

        for batch in batches:
            raw, at = arrow_text(batch.column(0))
            for _, sets in shingle_sets(raw, at, scheme.words):
                fresh = []
                for x in sets:
                    node = node_of(x)
                    if node is not None and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        fresh.append(x)
                if fresh:
                    s, w = signatures(fresh, scheme)
                    sig.append(s)
                    who.append(w + len(nodes) - len(fresh))
                    held += len(s)
                if held >= CHUNK:
                    yield from flush()
                    sig, who, nodes, seen, held = [], [], [], set(), 0
        if held:
            yield from flush()

    return run


_MEMBER_ARROW = pa.schema([("key", pa.int64()), ("node", pa.binary())])


def _signature(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)


def _meet(batches) -> Iterator[pa.RecordBatch]:
    """Members of the signatures that several nodes of a home partition share.

    Of one node in several chunks a signature makes no group here: the others that
    share it in a chunk come as known."""
    def emit(home, sig, names):
        keys = (np.int64(home) << 40) | sig.astype(np.int64)
        for a in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + 50_000]), pa.array(names[a:a + 50_000], pa.binary())], schema=_MEMBER_ARROW)

    held: dict[int, list] = {}
    for batch in batches:
        for _, home, known, low, high, who, nodes in zip(*(batch.column(i).to_pylist() for i in range(7))):
            of, names = np.frombuffer(who, np.uint16 if 5 * len(who) == 2 * (len(low) + len(high)) else np.uint32), np.frombuffer(nodes, "V16")
            if known:
                yield from emit(home, _signature(low, high), [x.tobytes() for x in names[of]])
            else:
                held.setdefault(home, []).append((low, high, of, names))
    for home, parts in held.items():
        names, sig = np.concatenate([p[3] for p in parts]), np.empty(sum(len(p[2]) for p in parts), np.uint64)
        of, at, start = np.empty(len(sig), np.uint32), 0, 0
        while parts:
            low, high, own, its = parts.pop()
            start += len(its)
            sig[at:at + len(own)], of[at:at + len(own)] = _signature(low, high), own + np.uint32(len(names) - start)
            at += len(own)
        order = np.argsort(sig)
        sig, of = sig[order], of[order]
        del order
        same = np.zeros(len(sig), bool)
        same[1:] = sig[1:] == sig[:-1]
        shared = same.copy()
        shared[:-1] |= same[1:]
        sig, names = sig[shared], names[of[shared]]
        halves = names.view(np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0], sig))
        sig, names, halves = sig[order], names[order], halves[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (halves[1:] != halves[:-1]).any(1)
        sig, names = sig[fresh], names[fresh]
        several = np.zeros(len(sig), bool)
        several[1:] = sig[1:] == sig[:-1]
        several[:-1] |= several[1:].copy()
        yield from emit(home, sig[several], [x.tobytes() for x in names[several]])


def _texts(words: int):
    """Each distinct node of a task's rows, with its size and sketch and a text that has its set."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep, names, sizes, sketches, row = [], [], [], [], 0
            for _, sets in shingle_sets(*arrow_text(batch.column(0)), words):
                for x in sets:
                    node = node_of(x)
                    if node is not None and node not in seen:
                        seen.add(node)
                        keep.append(row)
                        names.append(node)
                        sizes.append(len(x))
                        sketches.append(sketch(x))
                    row += 1
            if len(seen) > 1_000_000:
                seen = set()
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()),
                batch.column(0).take(pa.array(keep, pa.int64()))], names=["node", "size", "sketch", "text"])

    return run


_COMPARED = "node binary, hub binary, linked boolean, size int, most int, elements array<int>"
_COMPARED_ARROW = pa.schema([("node", pa.binary()), ("hub", pa.binary()), ("linked", pa.bool_()), ("size", pa.int32()), ("most", pa.int32()),
                             ("elements", pa.list_(pa.int32()))])


def difference_prefix(x: np.ndarray, hub: np.ndarray, scheme: Scheme) -> tuple[bool, int, int, np.ndarray]:
    """Whether ``x`` is linked with ``hub``, the size of their difference, the most in
    which ``x`` differs from a similar set, and the names (32 bits, each once) of the first
    elements of the difference, those of ``x`` first: twice as many as can matter, so that
    frequent ones can be moved behind.  Elements that share a name only add candidates."""
    added, gone = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    most = scheme.most(len(x))
    names = (mix(np.concatenate((added, gone))) >> np.uint64(32)).astype(np.uint32)
    at = np.sort(np.unique(names, return_index=True)[1])[:kept_names(most)]
    return bool(scheme.linked(len(x) - len(added), len(x), len(hub))), len(added) + len(gone), most, names[at].view(np.int32)


def kept_names(most):
    return 2 * (most + 1)


def _compare(scheme: Scheme):
    def run(batches) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray | None] = (None, None)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                nodes, hubs, derive = (batch.column(c).to_pylist() for c in (0, 1, 4))
                sets = [s for _, part in shingle_sets(*arrow_text(batch.column(2)), scheme.words) for s in part]
                raw, at = arrow_text(batch.column(3))
                found = []
                for i, (x, hub) in enumerate(zip(sets, hubs)):
                    if last[0] != hub:
                        one = raw[at[i]:at[i + 1]]
                        last = hub, next(s[0] for _, s in shingle_sets(one, np.array([0, len(one)]), scheme.words))
                    linked, size, most, first = difference_prefix(x, last[1], scheme)
                    found.append((linked, size, most, first if derive[i] else first[:0]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(nodes, pa.binary()), pa.array(hubs, pa.binary()),
                    *(pa.array([f[c] for f in found], _COMPARED_ARROW.types[c + 2]) for c in range(4))], schema=_COMPARED_ARROW)

    return run


def _pairs(members: DataFrame, of: DataFrame | None, slots: int) -> DataFrame:
    """Comparisons for groups ``key, node, n``, ``n`` their sizes: ``node, hub, derive``.

    The members of a group are dealt to ``slots`` by hash, and the best connected
    of each slot is a hub; the best of all is the group's first hub.  Members meet
    the hubs of other components.  A hub has then met its whole group; the other
    members must also meet the first hub, to ``derive`` their next groups."""
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    placed = members.select("key", "node").join(weight, "node")
    placed = placed.withColumn("component", F.col("node")) if of is None else placed.join(of, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    placed = store(placed.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(slots))), "join-placed")
    best = F.max(F.struct("weight", "node", "component")).alias("best")
    hubs = store(placed.groupBy("key", "slot").agg(best), "join-hubs")
    first = hubs.groupBy("key").agg(F.max("best")["node"].alias("hub"))
    rest = placed.join(hubs.select("key", F.col("best")["node"].alias("node")), ["key", "node"], "left_anti")
    follow = rest.join(first, "key").select("node", "hub", F.lit(True).alias("derive"))
    meet = placed.join(hubs.select("key", "best"), "key").where("node != best.node and component != best.component")
    meet = meet.select("node", F.col("best")["node"].alias("hub"), F.lit(False).alias("derive"))
    pairs = store(follow.unionByName(meet).groupBy("node", "hub").agg(F.max("derive").alias("derive")), "join-pairs")
    discard(placed, hubs)
    return pairs


def _met(pairs: DataFrame, bodies: DataFrame, columns: tuple[str, ...], members: int) -> DataFrame:
    """``pairs`` with ``columns`` of ``bodies``, the hub's as ``hub_...``; a hub of more than
    ``members`` members is dealt out in several copies."""
    load = pairs.groupBy("hub").agg(F.ceil(F.count("*") / members).cast("int").alias("copies"))
    dealt = pairs.join(load, "hub").withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
    hubs = load.join(bodies.select(F.col("node").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in columns)), "hub").select(
        "hub", *(f"hub_{c}" for c in columns), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return dealt.join(bodies.select("node", *columns), "node").join(hubs, ["hub", "copy"])


def _compared(pairs: DataFrame, bodies: DataFrame, scheme: Scheme) -> DataFrame:
    """The comparisons of ``pairs`` (``node, hub, derive``) by their texts."""
    both = _met(pairs, bodies, ("text",), HUB_MEMBERS).select("node", "hub", "text", "hub_text", "derive")
    return store(both.mapInArrow(_compare(scheme), _COMPARED), "join-compared")


_PAIR = "node binary, hub binary"
_PAIR_ARROW = pa.schema([("node", pa.binary()), ("hub", pa.binary())])


def _sift(scheme: Scheme):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(2, 6)))
            keep = pa.array([may_link(scheme, *row) for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR_ARROW).filter(keep)

    return run


def _near_linked(pairs: DataFrame, bodies: DataFrame, scheme: Scheme) -> DataFrame:
    """The links among ``pairs`` (``node, hub``): texts of those that the sketches leave."""
    both = _met(pairs, bodies, ("size", "sketch"), 16 * HUB_MEMBERS).select("node", "hub", "size", "sketch", "hub_size", "hub_sketch")
    left = store(both.mapInArrow(_sift(scheme), _PAIR), "join-sifted")
    compared = _compared(left.withColumn("derive", F.lit(False)), bodies, scheme)
    linked = _linked(compared)
    discard(left, compared)
    return linked


def _hubs(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Hubs of several members to derive from, and whether their sketches are too much work for a task (``wide``)."""
    counted = pairs.where("derive").groupBy("hub").agg(F.count("*").alias("members")).where("members > 1")
    held = bodies.select(F.col("node").alias("hub"), F.length("sketch").alias("held"))
    return store(counted.join(held, "hub").select("hub", (F.col("members") * F.col("members") * F.col("held") > SKETCH_WORK).alias("wide")), "join-wide")


def sketched_members(scheme: Scheme, size: np.ndarray, linked: np.ndarray, component: np.ndarray, cells: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a hub the others, each pair once, that their sketches leave possible,
    but for pairs of one component and two members that are linked with the hub."""
    order = np.argsort(size, kind="stable")
    size, linked, component = size[order], linked[order], component[order]
    nbytes = min(len(c) for c in cells)
    matrix = np.stack([folded(cells[i], nbytes) for i in order.tolist()])
    ends = np.searchsorted(size, size * 100 // scheme.percent, side="right")
    for x, end in enumerate(ends.tolist()):
        y = x + 1 + np.flatnonzero((component[x + 1:end] != component[x]) & ~(linked[x + 1:end] & linked[x]))
        if len(y):
            apart = np.bitwise_count(matrix[y] ^ matrix[x]).sum(1, dtype=np.int64)
            y = y[apart <= scheme.differ(size[x] + size[y])]
            if len(y):
                yield int(order[x]), order[y]


def _sketched(scheme: Scheme):
    """Pairs ``node, hub`` left to compare among members of the hubs, whose rows follow each other."""
    def pairs_of(hub: pa.Table) -> pa.RecordBatch:
        nodes, cells = (hub.column(c).to_pylist() for c in ("node", "sketch"))
        size = hub.column("size").to_numpy().astype(np.int64)
        linked = hub.column("linked").to_numpy()
        component = hub.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        left, right = [], []
        for x, ys in sketched_members(scheme, size, linked, component, cells):
            for y in ys.tolist():
                left.append(min(nodes[x], nodes[y]))
                right.append(max(nodes[x], nodes[y]))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], schema=_PAIR_ARROW)

    def run(batches) -> Iterator[pa.RecordBatch]:
        hub, held = None, []
        for batch in batches:
            hubs, at = batch.column(0).to_pylist(), 0
            for one, rows in itertools.groupby(hubs):
                n = sum(1 for _ in rows)
                if one != hub and held:
                    yield pairs_of(pa.Table.from_batches(held))
                    held = []
                hub = one
                held.append(batch.slice(at, n))
                at += n
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return run


def _left_by_sketches(pairs: DataFrame, hubs: DataFrame, linked: DataFrame, of: DataFrame, few: bool, bodies: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs ``node, hub`` that are left to compare among the members of hubs that aren't wide."""
    met = pairs.where("derive").join(hubs.where("not wide").select("hub"), "hub").select("node", "hub")
    known = linked.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(True).alias("linked"))
    met = met.join(known, ["node", "hub"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    open_hubs = met.groupBy("hub").agg(F.min("linked").alias("settled")).where("not settled").select("hub")
    rows = _placed(met.join(open_hubs, "hub"), of, few).join(bodies.select("node", "size", "sketch"), "node")
    rows = rows.select("hub", "node", "linked", "component", "size", "sketch").repartition("hub").sortWithinPartitions("hub")
    return store(rows.mapInArrow(_sketched(scheme), _PAIR).distinct(), "join-left")


def _open(compared: DataFrame) -> DataFrame:
    """The comparisons that next groups derive from, and whether their hub's members are
    paired up in one task (``local``): a hub of one member, or with all members linked,
    leaves nothing to find."""
    derived = compared.where(F.size("elements") > 0)
    hubs = derived.groupBy("hub").agg(F.count("*").alias("members"), F.sum(F.size("elements")).alias("held"), F.min("linked").alias("settled"))
    local = (F.col("members") <= LOCAL_MEMBERS) & (F.col("held") <= LOCAL_ELEMENTS)
    return derived.join(hubs.where("members > 1 and not settled").select("hub", "members", local.alias("local")), "hub")


def _placed(rows: DataFrame, of: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(of) if few else of, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_members(size: np.ndarray, most: np.ndarray, linked: np.ndarray, component: np.ndarray,
                 names: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a hub the later members that may be similar to it.

    Member ``i`` keeps ``names[at[i]:at[i + 1]]`` of its difference.  Of two similar
    members one's kept names end first in the common order, and all of these but the
    elements that the other's difference lacks are among the other's.  Members of one
    component, and two that are linked with the hub, need no comparison."""
    count = len(size)
    kept = np.diff(at)
    row = np.repeat(np.arange(count), kept)
    order = np.argsort(names, kind="stable")
    sorted_names, sorted_row = names[order], row[order]
    ends = np.searchsorted(sorted_names, sorted_names, side="right")
    after, later = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    after[order] = np.arange(1, len(names) + 1)
    later[order] = ends - np.arange(1, len(names) + 1)
    for x in range(count - 1):
        run, start = later[at[x]:at[x + 1]], after[at[x]:at[x + 1]]
        total = int(run.sum())
        if not total:
            continue
        ahead = np.arange(total) + np.repeat(start - (np.cumsum(run) - run), run)
        shared = np.bincount(sorted_row[ahead], minlength=count)
        y = np.flatnonzero(shared)
        differ = np.minimum(most[x], most[y])
        gap = size[x] - size[y]
        least = np.minimum(kept[x] - (differ + gap) // 2, kept[y] - (differ - gap) // 2)
        near = (np.abs(gap) <= differ) & (shared[y] >= least) & (component[y] != component[x]) & ~(linked[y] & linked[x])
        if near.any():
            yield x, y[near]


def _near(hub: pa.Table) -> pa.Table:
    """The pairs ``node, hub`` of the members of one hub that are left to compare."""
    whole = hub.combine_chunks()
    columns = {c: whole.column(c).combine_chunks() for c in ("node", "size", "most", "linked", "component", "elements")}
    lists = columns["elements"]
    at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    size, most = (columns[c].to_numpy().astype(np.int64) for c in ("size", "most"))
    component = columns["component"].dictionary_encode().indices.to_numpy()
    nodes, left, right = columns["node"].to_pylist(), [], []
    found = near_members(size, most, columns["linked"].to_numpy(zero_copy_only=False), component, lists.flatten().to_numpy(), at)
    for x, ys in found:
        for y in ys.tolist():
            left.append(min(nodes[x], nodes[y]))
            right.append(max(nodes[x], nodes[y]))
    return pa.table({"node": pa.array(left, pa.binary()), "hub": pa.array(right, pa.binary())})


def _sides(rows: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s in "xy")


def _rare_first(derived: DataFrame) -> DataFrame:
    """``elements`` cut to those that can be the first that two similar sets share, with
    the hub's most frequent elements behind all others.

    Any order serves that all members of a hub keep.  At most ``most`` elements of
    a hub are frequent, so what ``_compare`` has kept holds enough others."""
    crowded = derived.where(F.col("members") >= FREQUENT)
    counts = crowded.select("hub", "most", F.explode("elements").alias("element")).groupBy("hub", "element").agg(
        F.count("*").alias("n"), F.min("most").alias("most")).where(F.col("n") >= FREQUENT)
    place = F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("n"), "element"))
    least = F.min("most").over(Window.partitionBy("hub"))
    frequent = counts.withColumns({"place": place, "least": least}).where("place <= least")
    frequent = store(frequent.groupBy("hub").agg(F.collect_list("element").alias("frequent")), "join-frequent")
    none = F.array().cast("array<int>")
    listed = derived.join(frequent, "hub", "left").withColumn("frequent", F.coalesce("frequent", none))
    behind = F.when(F.size("elements") < kept_names(F.col("most")), F.array_intersect("elements", "frequent")).otherwise(none)
    ordered = F.concat(F.array_except("elements", "frequent"), behind)
    return listed.withColumn("elements", F.slice(ordered, F.lit(1), F.col("most") + 1)).drop("frequent")


def _linked(compared: DataFrame) -> DataFrame:
    return store(compared.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")), "join-linked")


def links(docs: DataFrame, scheme: Scheme, text_col: str = "text") -> DataFrame:
    """Links ``a, b`` between nodes that span the components of all similar pairs."""
    texts = numbered(docs).select(place(docs, text_col).alias("text"))
    parts = spread(docs, text_bytes(texts), PART_BYTES)
    signed = texts.mapInArrow(_sign(scheme, parts), _PACKED)
    grouped = store(signed.repartitionById(parts, "part").mapInArrow(_meet, "key bigint, node binary").distinct(), "join-shared")
    del signed
    release(docs.sparkSession)
    # a 40-bit signature of one node in several chunks is no group
    groups = grouped.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    groups = store(groups, "join-groups")
    twos = store(groups.where("n = 2").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(False).alias("derive")).distinct(), "join-twos")
    members = store(grouped.join(groups.where("n > 2").select("key", "n"), "key"), "join-members")
    discard(grouped, groups)

    wanted = members.select("node").union(twos.select("node")).union(twos.select("hub"))
    wanted = store(wanted.distinct(), "join-wanted")
    known = texts.mapInArrow(_texts(scheme.words), "node binary, size int, sketch binary, text string")
    few = wanted.count() <= BROADCAST_NODES
    bodies = store(known.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").dropDuplicates(["node"]), "join-texts")
    discard(wanted)

    found = of = None
    for turn in itertools.count():
        release(docs.sparkSession)
        pairs = _pairs(members, of, SLOTS[min(turn, len(SLOTS) - 1)])
        discard(members)
        if turn == 0:
            pairs = pairs.union(twos)
        if pairs.isEmpty():
            break
        hubs = _hubs(pairs, bodies)
        wide = pairs.where("derive").join(hubs.where("wide").select("hub"), "hub").select("node", "hub", "derive")
        widely = not hubs.where("wide").isEmpty()
        rest = pairs.join(wide, ["node", "hub", "derive"], "left_anti") if widely else pairs
        linked = _near_linked(rest.select("node", "hub").distinct(), bodies, scheme)
        found = linked if found is None else found.union(linked)
        if widely:
            compared = _compared(wide, bodies, scheme)
            found = found.union(_linked(compared))
        release(docs.sparkSession)
        if hubs.isEmpty():
            break
        of = components(found)
        few = of.count() <= BROADCAST_NODES
        release(docs.sparkSession)
        left = _left_by_sketches(pairs, hubs, linked, of, few, bodies, scheme)
        found = found.union(_near_linked(left, bodies, scheme))
        discard(left, pairs, hubs)
        release(docs.sparkSession)
        if not widely:
            break
        close, members = _wide_pairs(_open(compared), of, few)
        discard(compared)
        found = found.union(_near_linked(close, bodies, scheme))
        discard(close)
        if members.isEmpty():
            break
    empty = docs.sparkSession.createDataFrame([], "a binary, b binary")
    return empty if found is None else found


def _wide_pairs(derived: DataFrame, of: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Of the members of wide hubs the pairs ``node, hub`` left to compare, and the groups of the next round."""
    local = _placed(derived.where("local"), of, few).select("hub", "node", "linked", "size", "most", "component", "elements")
    local = store(local.groupBy("hub").applyInArrow(_near, _PAIR).distinct(), "join-local")
    release(derived.sparkSession)

    shared = _rare_first(derived.where("not local")).select("node", "hub", "linked", "size", "most", F.posexplode("elements").alias("pos", "element"))
    shared = shared.select(F.xxhash64("hub", "element").alias("key"), "node", "linked", "size", "most", "pos")
    worth = shared.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("pos") * 2 - F.col("most")).alias("lead"),
                                      F.min("linked").alias("linked")).where("n > 1 and lead <= 0 and not linked").select("key")
    grouped = store(shared.join(worth, "key"), "join-next")
    release(derived.sparkSession)
    placed = _placed(grouped, of, few)
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).where("a != b")
    mixed = store(mixed.select("key", "n"), "join-mixed")
    # pairs of one component need no comparison, nor do two members that are linked with the hub
    most = F.least("most_x", "most_y")
    near = ((F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & ~(F.col("linked_x") & F.col("linked_y"))
            & (F.abs(F.col("size_x") - F.col("size_y")) <= most) & (2 * F.col("pos_x") <= F.col("size_x") - F.col("size_y") + most)
            & (2 * F.col("pos_y") <= F.col("size_y") - F.col("size_x") + most))
    bounded = placed.join(mixed.where(F.col("n") <= SMALL_GROUP).select("key"), "key")
    left, right = _sides(bounded, ("node", "linked", "size", "most", "component", "pos"))
    close = left.join(right, (left["key"] == right["key"]) & near).select(F.col("node_x").alias("node"), F.col("node_y").alias("hub"))
    close = store(close.union(local).distinct(), "join-close")
    members = grouped.join(mixed.where(F.col("n") > SMALL_GROUP), "key").select("key", "node", "n")
    members = store(members, "join-members")
    discard(local, grouped, mixed)
    return close, members


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id``.

    Two rows are linked when the Jaccard similarity of their sets of ``words``-word
    shingles is ``percent`` or more; ``component_id`` is the smallest id reachable.
    A row of fewer words has the whole sequence as its only shingle; null, empty
    and blank texts have none and are linked with nothing.  Null ids are linked
    like others but never name a component that has another id.  Repeated rows
    are linked copies; an empty table gives no rows; other columns are ignored."""
    scheme = Scheme(words, percent)
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    rows = store(rows.mapInArrow(_nodes(words), f"id {id_type}, node binary, n_shingles bigint"), "join-nodes")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    joined = nodes.join(components(links(docs, scheme, text_col)), "node", "left")
    named = joined.select("node", "id", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of = store(named.join(smallest, "component").select("node", "component_id"), "join-components")
    return rows.join(of, "node", "left").select(
        "id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but all save one of each group of similar rows.

    The row of the smallest id stays; where ids are null or repeat, rows are told
    apart by their order instead, and the first stays.  Rows without shingles stay.  Columns
    keep their names, whatever they are; an empty table gives no rows."""
    plain = numbered(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    ids = plain.select(F.col(key).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1 or id is null").isEmpty():
        plain, key = store(plain.withColumn("row", F.monotonically_increasing_id()), "join-rows"), "row"
    groups = similar_groups(plain, words, percent, key, text)
    rest = store(groups.where("id != component_id").select(F.col("id").alias("gone")), "join-gone")
    kept = plain.join(rest, plain[key] == rest["gone"], "left_anti")
    return kept.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)

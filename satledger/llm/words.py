"""Vectorised word hashes over Arrow text, in blocks of bounded size.

A word is a maximal run of word bytes.  Its 64-bit hash is the difference of
two prefix sums of a polynomial hash (mod 2**64, odd multiplier, a random
value per byte), so one pass over the bytes hashes every word.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Alphabet:
    """Which bytes belong to words, and a random value per (lower-cased) byte."""

    def __init__(self, is_word, lower: bool = True):
        self.is_word = np.array([bool(is_word(b)) for b in range(256)])
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.values = np.where(self.is_word, values[fold], np.uint64(0))


#: Words are what white space does not split.
SPACED = Alphabet(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of ASCII letters and digits and all characters beyond ASCII.
ALNUM = Alphabet(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def _hash_block(data: np.ndarray, first: np.ndarray, last: np.ndarray, alphabet: Alphabet, prefixes: tuple[int, ...] = ()):
    """Hashes and starts of the words of one block of bytes; ``first`` and ``last``:
    where its (non-empty) documents begin and end.  With ``prefixes`` the hashes
    are a matrix: whole words, then a row for each length of prefix in bytes (0 for
    a word that is not longer)."""
    n = len(data)
    up, down = _power_table(n + 1)
    word = alphabet.is_word[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[first] = word[first]
    ends[last - 1] = word[last - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(alphabet.values[data] * up[:n], out=sums[1:])
    whole = mix((sums[e] - sums[s]) * down[s])
    if not prefixes:
        return whole, s
    rows = [whole]
    for length in prefixes:
        longer = e - s > length
        cut = mix((sums[np.where(longer, s + length, s)] - sums[s]) * down[s] + np.uint64(length))
        rows.append(np.where(longer, cut, np.uint64(0)))
    return np.stack(rows), s


def hashed_words(raw: np.ndarray, at: np.ndarray, alphabet: Alphabet, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents ``(first, end, hashes, bounds)``: document ``first + i``
    has the words ``hashes[bounds[i]:bounds[i + 1]]``.  Work space is a few
    blocks, whatever the size of the batch; a longer document is cut between
    words and put together again.  ``prefixes``: see ``_hash_block``."""
    n, d = len(at) - 1, 0
    while d < n:
        end = max(d + 1, int(np.searchsorted(at, at[d] + BLOCK, side="right")) - 1)
        lo, hi = int(at[d]), int(at[end])
        if hi - lo <= BLOCK:
            starts, stops = at[d:end] - lo, at[d + 1:end + 1] - lo
            full = stops > starts
            h, s = _hash_block(raw[lo:hi], starts[full], stops[full], alphabet, prefixes)
            yield d, end, h, np.append(np.searchsorted(s, starts), len(s))
        else:
            pieces, a = [], lo
            while a < hi:
                b = min(hi, a + BLOCK)
                while b < hi and alphabet.is_word[raw[b - 1]] and alphabet.is_word[raw[b]]:
                    gaps = np.flatnonzero(~alphabet.is_word[raw[b:b + BLOCK]])
                    b = b + int(gaps[0]) if len(gaps) else min(hi, b + BLOCK)
                pieces.append(_hash_block(raw[a:b], np.array([0]), np.array([b - a]), alphabet, prefixes)[0])
                a = b
            h = np.concatenate(pieces, axis=-1)
            yield d, end, h, np.array([0, h.shape[-1]])
        d = end


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each document and their bounds; a
    document of fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(bounds)
    n = len(h)
    sums = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        sums += h[j:j + len(sums)] * np.uint64(pow(_MULTIPLIER, 3 * j + 1, 1 << 64) | 1)
    sums = mix(sums)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(out_at[-1]), np.uint64)
    for i, (c, b, o) in enumerate(zip(counts.tolist(), bounds.tolist(), out_at.tolist())):
        if c >= k:
            out[o:o + c - k + 1] = sums[b:b + c - k + 1]
        elif c:
            acc = np.array([c], np.uint64)
            for x in h[b:b + c]:
                acc = mix(acc * np.uint64(_MULTIPLIER) + x)
            out[o] = acc[0]
    return out, out_at

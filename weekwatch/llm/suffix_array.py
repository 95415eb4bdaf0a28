"""Suffix arrays by induced sorting and permuted common prefixes, for one shard of bytes in numpy.

Suffixes are classified by type, leftmost-smaller (LMS) substrings are sorted by inducing and named, the string of
names is sorted recursively, and the order of its suffixes induces the whole array in linear time. A symbol's bucket is
induced as arrays: all its entries at hand go at once, those they add to the same bucket in the next wave.
"""

from __future__ import annotations

import numpy as np

#: Strings of names with more symbols than this have buckets of about one entry; they are sorted by doubling instead.
BUCKETS = 4096


def _places(n: int) -> type:
    """The smallest type that holds the places of ``n`` symbols; arrays of places are most of a shard's memory."""
    return np.int32 if n < 2**31 else np.int64


def _induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes given an order of the LMS suffixes in each bucket (``seeds``, grouped by symbol)."""
    left: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    cuts = np.searchsorted(text[seeds], np.arange(symbols + 1))

    def deal(at: np.ndarray, to: list[list[np.ndarray]]) -> None:
        if len(at) == 0:
            return
        symbol = text[at]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        ends = np.flatnonzero(np.diff(symbol)) + 1
        for part, first in zip(np.split(at, ends), symbol[np.concatenate(([0], ends))].tolist()):
            to[first].append(part)

    def waves(now: list[np.ndarray], c: int, to, want_s: bool) -> np.ndarray:
        out = []
        at = np.concatenate(now) if now else seeds[:0]
        while len(at):
            out.append(at)
            before = at[at > 0] - 1
            before = before[is_s[before] == want_s]
            same = text[before] == c
            deal(before[~same], to)
            at = before[same]
        now.clear()
        return np.concatenate(out) if out else seeds[:0]

    l_part: list[np.ndarray] = []
    for c in range(symbols):
        l_part.append(waves(left[c], c, left, False))
        lms = seeds[cuts[c] : cuts[c + 1]]
        before = lms[lms > 0] - 1
        deal(before[~is_s[before]], left)
    right: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    buckets: list[np.ndarray] = [None] * symbols
    for c in range(symbols - 1, -1, -1):
        s_part = waves(right[c], c, right, True)
        entries, l_part[c] = l_part[c][::-1], None
        before = entries[entries > 0] - 1
        before = before[is_s[before] & (text[before] < c)]
        deal(before, right)
        if c == 0:  # the end mark is the smallest suffix and nothing induces it
            s_part = np.concatenate((s_part, seeds[cuts[0] : cuts[1]]))
        buckets[c] = np.concatenate((entries[::-1], s_part[::-1]))
    return np.concatenate(buckets)


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string over many symbols: ranks of prefixes of doubling length."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:-step or None] = rank[step:] + 1 if step < n else 0
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key)
        new = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in ascending order; its last symbol is 0 and occurs nowhere else."""
    n = len(text)
    kind = _places(n)
    if n == 1:
        return np.zeros(1, dtype=kind)
    if symbols > BUCKETS:
        return _doubled(text).astype(kind)
    differ = np.append(text[:-1] != text[1:], True)
    end = np.where(differ, np.arange(n, dtype=kind), kind(n))  # last place of each run of equal symbols
    end = np.minimum.accumulate(end[::-1])[::-1]
    following = np.append(text[1:], -1)
    is_s = text < following[end]
    is_s[-1] = True
    del differ, end, following
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(kind)
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    order = _induce(text, is_s, by_symbol, symbols)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    sorted_lms = order[is_lms[order]]
    del order, is_lms
    size = np.diff(np.append(lms, kind(n - 1))) + 1  # an LMS substring ends at the start of the next one
    length = np.zeros(n, dtype=kind)
    length[lms] = size
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length[a] == length[b]
    alive, k = np.flatnonzero(same), 0
    while len(alive):
        x, y = a[alive], b[alive]
        equal = (text[x + k] == text[y + k]) & (is_s[x + k] == is_s[y + k])
        same[alive[~equal]] = False
        k += 1
        alive = alive[equal]
        alive = alive[length[a[alive]] > k]
    names = np.cumsum(np.concatenate(([0], ~same)))
    name_of = length  # the lengths are needed no more
    name_of[sorted_lms] = names
    if names[-1] + 1 < len(lms):
        sorted_lms = lms[suffix_array(name_of[lms], int(names[-1]) + 1)]
    seeds = sorted_lms[np.argsort(text[sorted_lms], kind="stable")]
    return _induce(text, is_s, seeds, symbols)


def common_prefixes(octets: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in text order its predecessor in the suffix array and whether they share ``most`` bytes.

    These are permuted common prefixes, cut at ``most``: places are compared eight bytes at a time, all at once, and
    drop out at their first difference.
    """
    n = len(octets)
    before = np.full(n, -1, dtype=order.dtype)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((octets, np.zeros(most + 8, dtype=np.uint8)))
    word = np.zeros(n + most, dtype=np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n + most].astype(np.uint64)
    alive = np.flatnonzero((before[: max(0, n - most + 1)] >= 0) & (before[: max(0, n - most + 1)] <= n - most))
    if most < 8:
        word >>= np.uint64(8 * (8 - most))
    for k in [*range(0, most - 7, 8), *([max(0, most - 8)] if most % 8 else [])]:
        alive = alive[word[alive + k] == word[before[alive] + k]]
    out = np.full(n, -1, dtype=order.dtype)
    out[alive] = before[alive]
    return out


def repeated_windows(pieces: list[bytes], keys: list[tuple[int, int]], width: int) -> list[np.ndarray]:
    """For each piece, the offsets of windows of ``width`` bytes that also start at a smaller ``(document, place)``.

    ``keys`` are document and place of each piece's first byte. Windows do not cross pieces.
    """
    lengths = np.array([len(p) for p in pieces])
    total = int(lengths.sum()) + len(pieces) + 1
    text = np.ones(total, dtype=np.int16)  # 1 ends a piece, 0 ends the text, bytes are 2 and more
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    inside = np.ones(total, dtype=bool)
    inside[starts + lengths] = False
    inside[-1] = False
    text[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int16) + 2
    text[-1] = 0
    order = suffix_array(text, 258)
    piece = np.repeat(np.arange(len(pieces), dtype=order.dtype), lengths + 1)
    offset = np.arange(total - 1, dtype=order.dtype) - starts.astype(order.dtype)[piece]
    valid = np.append(offset + width <= lengths[piece], False)
    octets = np.zeros(total, dtype=np.uint8)
    octets[inside] = (text[inside] - 2).astype(np.uint8)
    follows = common_prefixes(octets, order, width)
    del text, inside, octets
    ranked = order[valid[order]]  # suffixes that share a whole window stand side by side
    rank_before = np.append(-1, ranked[:-1])
    joined = follows[ranked] >= 0
    joined &= follows[ranked] == rank_before
    group = np.cumsum(~joined) - 1
    documents, places = (np.array([k[i] for k in keys], dtype=np.int64) for i in (0, 1))
    own = piece[ranked]
    place = places[own] + offset[ranked]
    by = np.lexsort((place, documents[own], group))
    first = np.ones(len(by), dtype=bool)
    first[1:] = group[by][1:] != group[by][:-1]
    later = ranked[by[~first]]
    later = later[np.argsort(later)]
    cut = np.searchsorted(later, np.append(starts, total))
    return [offset[later[a:b]] for a, b in zip(cut, cut[1:])]

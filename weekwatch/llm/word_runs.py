"""Periodic runs of words by grammar-compressed run detection.

The word ids of a document are compressed by Re-Pair: each round replaces the pairs that are locally the most frequent
by new symbols, until no pair occurs twice; what is left is paired up into a balanced top. So every boundary between
two neighbouring words belongs to one symbol of the derivation tree. Runs that cross a symbol's inner boundary are
computed once for each distinct symbol, at its first occurrence, moved to all positions where the symbol is derived,
and intervals inside another one of the same period are merged into it. A run lies whole inside the lowest symbol that
holds it, so none is missed; a piece that a symbol's rim cuts off lies inside the whole run and goes.

Whether stretches are equal is answered by exact names: stretches of 1, 2, 4, ... words that occur more than once in
their document have a number, equal ones the same. A run of period q and at least 4q words has 2q of them on one side of
the boundary, so a name of length between q/2 and q at the boundary occurs again q words away; only such q are tried.

Documents are processed some at a time inside a task; ids are unique to a document, so runs never cross documents.

Defined results: a null text has no words, no runs and the empty collapsed text, like an empty one; repeated rows are
treated each for itself; all input columns stay, except those named like an output, which are replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Words of a run at least, and periods of a run at least (4 or more: the search needs two on one side).
SHORTEST, POWER = 6, 4
#: Words taken at a time in a task (one document at least), and candidate periods tried at a time.
BATCH_WORDS, BATCH_TRIALS = 1 << 18, 1 << 20


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space (tab to carriage return, and space), as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


class Symbols:
    """Occurrences of compound symbols: rule number, first word, inner boundary, end; at least ``SHORTEST`` words."""

    def __init__(self, shortest: int):
        self.shortest, self.parts = shortest, []

    def add(self, rule: np.ndarray, start: np.ndarray, inner: np.ndarray, end: np.ndarray) -> None:
        far = end - start >= self.shortest
        if far.any():
            self.parts.append((rule[far], start[far], inner[far], end[far]))

    def sorted(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, dtype=np.int64),) * 4
        rule, start, inner, end = map(np.concatenate, zip(*self.parts))
        order = np.lexsort((start, rule))
        return rule[order], start[order], inner[order], end[order]


def grammar(words: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """Occurrences of the symbols of a Re-Pair grammar over all documents, sorted by rule and position."""
    n, made = len(words), Symbols(shortest)
    symbol, start, end, own = words.copy(), np.arange(n), np.arange(1, n + 1), doc
    fresh = int(words.max()) + 1 if n else 0
    frequent = np.bincount(words)[words] > 1 if n else np.zeros(0, dtype=bool)
    maybe = np.append(frequent[:-1] & frequent[1:], False) if n else frequent
    left_over = []
    while len(symbol):
        at = np.flatnonzero(maybe)
        at = at[at + 1 < len(symbol)]
        twin = symbol[at] == symbol[at + 1]
        if twin.any():  # of overlapping pairs of one symbol the first, third, ... from the left
            linked = np.concatenate(([False], twin[1:] & twin[:-1] & (at[1:] == at[:-1] + 1)))
            index = np.arange(len(at))
            odd = (index - np.maximum.accumulate(np.where(linked, 0, index))) % 2 == 1
        else:
            odd = np.zeros(len(at), dtype=bool)
        even = at[~odd]
        key = symbol[even] << 32 | symbol[even + 1]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        cuts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(cuts, len(key)))
        often = np.zeros(len(key), dtype=np.int64)
        often[order] = np.repeat(times, times)
        pairs = even[often > 1]
        live = np.zeros(int(own[-1]) + 1, dtype=bool)
        live[own[pairs]] = True
        if not live.all():
            done = ~live[own]
            left_over.append((start[done], end[done], own[done]))
        if not len(pairs):
            break
        # the most frequent pair of a neighbourhood wins; scattered bits of the pair decide between equals
        weight = np.zeros(len(symbol) + 2, dtype=np.int64)
        scattered = (key[often > 1] * np.int64(-7046029254386353131)) >> 34 & 0x3FFFFFFF
        weight[pairs + 1] = often[often > 1] << 30 | scattered
        wins = (weight[pairs + 1] > weight[pairs]) & (weight[pairs + 1] >= weight[pairs + 2])
        chosen = pairs[wins]
        found, rule = np.unique(key[often > 1][wins], return_inverse=True)
        made.add(fresh + rule, start[chosen], start[chosen + 1], end[chosen + 1])
        symbol[chosen] = fresh + rule
        fresh += len(found)
        end[chosen] = end[chosen + 1]
        new = np.zeros(len(symbol) + 1, dtype=bool)
        new[chosen] = True
        again = np.zeros(len(symbol), dtype=bool)
        again[pairs] = True
        again[at[odd]] = True
        keep = live[own]
        keep[chosen + 1] = False
        symbol, start, end, own, again = symbol[keep], start[keep], end[keep], own[keep], again[keep]
        new = np.append(new[:-1][keep], False)
        maybe = again | new[:-1] | new[1:]
    if left_over:
        start, end, own = map(np.concatenate, zip(*left_over))
        order = np.argsort(start)
        _balanced(start[order], end[order], own[order], fresh, made)
    return made.sorted()


def _balanced(start: np.ndarray, end: np.ndarray, own: np.ndarray, fresh: int, made: Symbols) -> None:
    """Pair up neighbouring symbols of each document until one is left."""
    while True:
        first = np.concatenate(([True], own[1:] != own[:-1]))
        index = np.arange(len(own))
        even = (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
        left = np.flatnonzero(even[:-1] & ~even[1:])
        if not len(left):
            return
        made.add(fresh + np.arange(len(left)), start[left], start[left + 1], end[left + 1])
        fresh += len(left)
        end[left] = end[left + 1]
        start, end, own = start[even], end[even], own[even]


class Names:
    """``levels[t][i]``: number of the stretch of 2^t words at i, equal for equal stretches; -1 where it occurs once."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        level = np.where(np.bincount(words)[words] > 1, words, -1)
        self.levels = []
        while (level >= 0).any():
            self.levels.append(level)
            width = 1 << len(self.levels) - 1
            at = np.flatnonzero(level[:max(0, self.n - width)] >= 0)
            at = at[level[at + width] >= 0]
            _, name, times = np.unique(level[at] << 32 | level[at + width], return_inverse=True, return_counts=True)
            level = np.full(self.n, -1, dtype=np.int64)
            again = times[name] > 1
            level[at[again]] = name[again]

    def alike_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on, i < j."""
        i, j, begun = i.copy(), j.copy(), j
        for t in reversed(range(len(self.levels))):
            level, last = self.levels[t], self.n - 1
            same = (j <= last) & (level[np.minimum(i, last)] == level[np.minimum(j, last)]) & (level[np.minimum(j, last)] >= 0)
            i, j = i + (same << t), j + (same << t)
        return j - begun

    def alike_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words that end before i and j, i < j."""
        i, j, begun = i.copy(), j.copy(), j
        for t in reversed(range(len(self.levels))):
            level, width = self.levels[t], 1 << t
            x, y = np.maximum(i - width, 0), np.maximum(j - width, 0)
            same = (i >= width) & (level[x] == level[y]) & (level[y] >= 0)
            i, j = i - (same << t), j - (same << t)
        return begun - j


def crossing(names: Names, start: np.ndarray, inner: np.ndarray, end: np.ndarray, shortest: int, power: int):
    """Runs over the inner boundary of each symbol, cut off at its rims: (symbol index, first word, end, period)."""
    found = [[np.zeros(0, dtype=np.int64)] * 4]
    for t, level in enumerate(names.levels):
        width = 1 << t
        own = np.flatnonzero(end - start >= max(shortest, power * width))
        if not len(own):
            break
        at = np.flatnonzero(level >= 0)
        known = np.sort(level[at] << 32 | at)
        s, b, e = start[own], inner[own], end[own]
        # two periods on the left: the stretch before the boundary, again q words earlier; on the right: mirrored
        before, after = np.maximum(b - width, 0), np.minimum(b, names.n - 1)
        sides = [(np.where(b - width >= s, level[before], -1), np.maximum(s, b - 3 * width + 1), b - 2 * width + 1, before),
                 (np.where(b + width <= e, level[after], -1), b + width, np.minimum(e, b + 2 * width), after)]
        for name, first, stop, here in sides:
            low = np.searchsorted(known, name << 32 | np.maximum(first, 0))
            high = np.searchsorted(known, name << 32 | np.maximum(stop, 0))
            many = np.where((name >= 0) & (stop > first), high - low, 0)
            some = np.flatnonzero(many)
            group = np.cumsum(many[some]) // BATCH_TRIALS
            for part in np.split(some, np.flatnonzero(np.diff(group)) + 1):
                if not len(part):
                    continue
                k = np.repeat(part, many[part])
                step = np.arange(len(k)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
                other = known[low[k] + step] & 0xFFFFFFFF
                q = np.abs(here[k] - other)
                i = np.where(other < here[k], b[k] - q, b[k])
                first_word = np.maximum(s[k], i - names.alike_before(i, i + q))
                beyond = np.minimum(e[k], i + q + names.alike_after(i, i + q))
                good = (beyond - first_word >= np.maximum(shortest, power * q)) & (first_word < b[k]) & (beyond > b[k])
                found.append([own[k[good]], first_word[good], beyond[good], q[good]])
    symbol, first_word, beyond, q = map(np.concatenate, zip(*found))
    order = np.lexsort((q, beyond, first_word, symbol))  # of one stretch the smallest period
    symbol, first_word, beyond, q = symbol[order], first_word[order], beyond[order], q[order]
    fresh = np.ones(len(q), dtype=bool)
    fresh[1:] = (symbol[1:] != symbol[:-1]) | (first_word[1:] != first_word[:-1]) | (beyond[1:] != beyond[:-1])
    return symbol[fresh], first_word[fresh], beyond[fresh], q[fresh]


def runs_of(words: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """All maximal runs (first word, end, period) of documents laid end to end, by first word, then period."""
    rule, start, inner, end = grammar(words, doc, shortest)
    none = np.zeros(0, dtype=np.int64)
    if not len(rule):
        return none, none, none
    first = np.flatnonzero(np.concatenate(([True], rule[1:] != rule[:-1])))  # a symbol's first occurrence stands for it
    many = np.diff(np.append(first, len(rule)))
    symbol, a, z, q = crossing(Names(words), start[first], inner[first], end[first], shortest, power)
    times = many[symbol]  # to all derivation positions
    k = np.repeat(np.arange(len(symbol)), times)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
    moved = start[first[symbol[k]] + nth] - start[first[symbol[k]]]
    a, z, q = a[k] + moved, z[k] + moved, q[k]
    order = np.lexsort((-z, a, q))  # merge: what lies inside an earlier one of its period goes
    a, z, q = a[order], z[order], q[order]
    reach = q * (len(words) + 1) + z
    whole = np.ones(len(q), dtype=bool)
    whole[1:] = (q[1:] != q[:-1]) | (reach[1:] > np.maximum.accumulate(reach)[:-1])
    a, z, q = a[whole], z[whole], q[whole]
    order = np.lexsort((q, a))
    return a[order], z[order], q[order]


def collapse(docs: list[list[bytes]], shortest: int = SHORTEST, power: int = POWER) -> Iterator[tuple]:
    """For each document: number of words, its runs, and the text with one period of each."""
    sizes = [len(d) for d in docs]
    ids, fresh = [], count()
    for d in docs:
        numbers = defaultdict(fresh.__next__)
        ids += map(numbers.__getitem__, d)
    words = np.array(ids, dtype=np.int64)
    a, z, q = runs_of(words, np.repeat(np.arange(len(docs)), sizes), shortest, power)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, a + q, 1)
    np.add.at(change, z, -1)
    kept = np.cumsum(change)[:-1] == 0
    bases = np.cumsum([0, *sizes])
    cuts = np.searchsorted(a, bases)
    for d, base, lo, hi in zip(docs, bases[:-1], cuts, cuts[1:]):
        left = d if lo == hi else [w for w, k in zip(d, kept[base:base + len(d)]) if k]
        runs = [{"start": s, "length": e - s, "period": p} for s, e, p in zip((a[lo:hi] - base).tolist(), (z[lo:hi] - base).tolist(), q[lo:hi].tolist())]
        yield len(d), runs, b" ".join(left).decode("utf-8", "surrogatepass")


def collapse_runs(df: DataFrame, text: str = "text", shortest: int = SHORTEST, power: int = POWER) -> DataFrame:
    """Adds ``n_words``, ``runs`` (array of start, length and period, by start and period) and ``collapsed``, the words
    outside runs and the first period of each run, joined by one space."""
    if power < 4:
        raise ValueError("runs of fewer than four periods are not searched for")
    made = ["n_words", "runs", "collapsed"]

    @F.pandas_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows, docs, held = [], [], 0
            for t in batch:
                docs.append(split_words(t))
                held += len(docs[-1])
                if held >= BATCH_WORDS:
                    rows += collapse(docs, shortest, power)
                    docs, held = [], 0
            rows += collapse(docs, shortest, power)
            yield pd.DataFrame(rows, columns=made)

    kept = [c for c in df.columns if c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    done = df.select(row.alias("row"), found(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("made"))
    return done.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col("made")[c].alias(c) for c in made])

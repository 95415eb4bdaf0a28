"""Benchmark decontamination with a positional inverted index.

Training texts are indexed once: each index row covers the documents of one batch and stores, for every test term in
them, the ascending positions of that term (postings), with the frequency of the term over all documents added up from
these rows. A test window is looked up from its rarest term: that list, adjusted by the term's offset, is intersected
with the lists of the next rarer terms until it is empty or every word of the window has been met, which makes the match
exact. Proximity matches keep the windows whose words all stand near an occurrence of the rarest.

The index is partitioned by document, so nothing is shuffled and no term, however frequent, meets in one task. Test
windows are the query set; they reach the tasks in blocks of at most ``BLOCK_WORDS`` words, so a broadcast has a bound
whatever the size of the test table.

Defined results: null and empty texts have no words, no hits and no items; a test item shorter than a window, but not
empty, is one window; equal windows of several items count for each; rows with a null item id are left out; repeated
documents are matched each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weekwatch.llm.worker import release
from weekwatch.session import new_path

#: Words of test windows in one broadcast; tokens of one index row.
BLOCK_WORDS, ROW_TOKENS = 2_000_000, 1_000_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
               for b in range(256))
_INDEX = "doc_ids array<long>, marks array<string>, n_words array<long>, terms array<int>, sizes array<int>, postings binary"


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters that are letters or digits, or not ASCII; A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Windows:
    """A block of test windows: vocabulary, words of each window as term numbers, and the items that have it."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}

    def add(self, item: str, window: list[bytes]) -> None:
        self.items.setdefault(tuple(self.terms.setdefault(w, len(self.terms)) for w in window), set()).add(item)


def blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[Windows]:
    """The test windows, in blocks; the driver holds one block and one partition of the test table at a time."""
    block, held = Windows(), 0
    rows = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        found = words(row.t)
        for at in range(max(1, len(found) - size + 1) if found else 0):
            window = found[at : at + size]
            block.add(row.i, window)
            held += len(window)
            if held >= BLOCK_WORDS:
                yield block
                block, held = Windows(), 0
    if block.items:
        yield block


def build_index(docs: DataFrame, terms: dict[bytes, int], path: str, gap: int) -> DataFrame:
    """Store the postings of ``terms`` in ``docs(doc_id, mark, text)``; ``gap`` keeps documents of a row apart."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def row(held: list) -> dict:
        ids, marks, counts, numbers = zip(*held)
        at, places = 0, []
        for n in counts:
            places.append(at)
            at += n + gap
        number = np.concatenate(numbers)
        place = np.concatenate([np.arange(len(x)) + p for x, p in zip(numbers, places)])
        known = number >= 0
        number, place = number[known], place[known]
        order = np.argsort(number, kind="stable")
        number, place = number[order], place[order].astype(np.int32)
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        sizes = np.diff(np.append(cuts, len(number)))
        steps = np.diff(place, prepend=0)  # differences are small numbers and compress well
        return {"doc_ids": list(ids), "marks": list(marks), "n_words": list(counts), "terms": number[cuts].tolist(),
                "sizes": sizes.tolist(), "postings": steps.astype(np.int32).tobytes()}

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        get = shared.value.get
        held, tokens = [], 0
        for pdf in batches:
            for doc, mark, text in zip(pdf["doc_id"].astype(object), pdf["mark"], pdf["text"]):
                found = words(text)
                numbers = np.array(list(map(get, found, repeat(-1))), dtype=np.int32)
                held.append((None if pd.isna(doc) else int(doc), mark, len(found), numbers))
                tokens += len(found) + gap
                if tokens >= ROW_TOKENS:
                    yield pd.DataFrame([row(held)])
                    held, tokens = [], 0
        if held:
            yield pd.DataFrame([row(held)])

    docs.mapInPandas(index, _INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


def frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """Occurrences of each term of a block over all documents."""
    sums = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(
        F.sum("t.sizes").alias("n"))
    out = np.zeros(terms, dtype=np.int64)
    for term, n in sums.collect():  # at most the vocabulary of one block
        out[term] = n
    return out


def _near(lists: list[np.ndarray], reach: int) -> np.ndarray:
    """Occurrences of the first list with one of every other list at most ``reach`` words away."""
    at = lists[0]
    for other in lists[1:]:
        k = np.searchsorted(other, at - reach)
        at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] <= at + reach)]
    return at


def search(index: DataFrame, block: Windows, counts: np.ndarray, size: int, gap: int, slop: int | None) -> DataFrame:
    """One row per document: ``doc_id, mark, n_words``, hit runs ``starts, stops``, ``items`` of exact matches and, if
    ``slop`` is given, ``near_items`` whose window stands within ``size + slop`` words."""
    plan: dict[int, list] = {}
    for window, items in block.items.items():
        order = sorted(range(len(window)), key=lambda k: (counts[window[k]], k))
        if counts[window[order[0]]]:
            plan.setdefault(window[order[0]], []).append((window, order, sorted(items)))
    shared = index.sparkSession.sparkContext.broadcast(plan)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                sizes, terms, steps = np.array(r.sizes, dtype=np.int64), r.terms.tolist(), np.frombuffer(r.postings, dtype=np.int32)
                ends = np.cumsum(sizes)
                places = np.cumsum(steps, dtype=np.int64)
                lists = {t: places[e - n : e] for t, e, n in zip(terms, ends, sizes)}
                docs = len(r.n_words)
                first = np.concatenate(([0], np.cumsum(np.array(r.n_words) + gap)))[:-1]
                covered = np.zeros(int(first[-1]) + int(r.n_words[-1]) + gap + 1, dtype=np.int32)
                exact, near = [set() for _ in range(docs)], [set() for _ in range(docs)]
                for rare in terms:
                    for window, order, items in shared.value.get(rare, ()):
                        if any(t not in lists for t in window):
                            continue
                        at = lists[rare] - order[0]
                        for k in order[1:]:
                            have = lists[window[k]]
                            j = np.minimum(np.searchsorted(have, at + k), len(have) - 1)
                            at = at[have[j] == at + k]
                            if not len(at):
                                break
                        np.add.at(covered, at, 1)
                        np.add.at(covered, at + len(window), -1)
                        for d in (np.searchsorted(first, at, side="right") - 1).tolist():
                            exact[d].update(items)
                        if slop is not None:
                            close = _near([lists[window[k]] for k in order], len(window) - 1 + slop)
                            for d in (np.searchsorted(first, close, side="right") - 1).tolist():
                                near[d].update(items)
                hit = np.cumsum(covered) > 0
                edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
                starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                own = np.searchsorted(first, starts, side="right") - 1
                cut = np.searchsorted(own, np.arange(docs + 1))
                yield pd.DataFrame({
                    "doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "mark": r.marks, "n_words": r.n_words,
                    "starts": [(starts[a:b] - first[d]).tolist() for d, (a, b) in enumerate(zip(cut, cut[1:]))],
                    "stops": [(stops[a:b] - first[d]).tolist() for d, (a, b) in enumerate(zip(cut, cut[1:]))],
                    "items": [sorted(x) for x in exact], "near_items": [sorted(x) for x in near]})

    return index.mapInPandas(find, "doc_id long, mark string, n_words long, starts array<long>, stops array<long>, "
                                   "items array<string>, near_items array<string>")


def _united(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The results of several blocks, put together for each document; equal rows come back as often as they came."""

    @F.pandas_udf("starts array<long>, stops array<long>")
    def union(starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(starts, stops):
            runs: list[list[int]] = []
            for x, y in sorted(zip(a, b)):
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y)
                else:
                    runs.append([x, y])
            out.append(([r[0] for r in runs], [r[1] for r in runs]))
        return pd.DataFrame(out, columns=["starts", "stops"])

    whole = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  at most the blocks' arrays of one document
    one = rows.distinct().groupBy("doc_id", "mark").agg(F.max("n_words").alias("n_words"), *map(
        whole, ("starts", "stops", "items", "near_items")))
    one = one.withColumn("_r", union("starts", "stops")).select(
        F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "n_words", "_r.starts", "_r.stops",
        F.array_sort(F.array_distinct("items")).alias("items"),
        F.array_sort(F.array_distinct("near_items")).alias("near_items"))
    return docs.select("doc_id", "mark").join(one, F.expr("doc_id <=> _d AND mark = _m")).drop("_d", "_m")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int | None = 5, id_column: str = "doc_id",
            text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document with its exact and near matches; see ``search``. Ids are longs."""
    marked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    gap, parts = size + 2 * (slop or 0), []
    for block in chain(blocks(benchmark, item, item_text, size), [None]):
        if block is None and parts:
            break
        block = block or Windows()
        index = build_index(marked, block.terms, new_path(docs.sparkSession, "postings"), gap)
        parts.append(search(index, block, frequencies(index, len(block.terms)), size, gap, slop))
    found = parts[0] if len(parts) == 1 else _united(reduce(DataFrame.union, parts), marked)
    return found.withColumn("n_hit", F.aggregate(
        F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b))

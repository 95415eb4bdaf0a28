"""Removal of long repeated byte strings with sharded suffix arrays.

A window is ``width`` bytes of one document. Every byte in a window that also starts earlier (smaller document, or same
document and smaller place) is removed. Windows are dealt out by content: the smallest hash among a window's
``GRAM``-byte strings is its anchor, equal windows have equal anchors, and neighbours with one anchor form a stretch.
Only anchors met twice can hide a repeat, so only their stretches go on; equal stretches count once (their later copies
are repeats as a whole), and the different stretches of an anchor meet in a shard, where a suffix array made by induced
sorting and its permuted common prefixes find windows that start earlier.

An anchor with very many different stretches (the rims of a passage that a large part of the corpus shares), or with more
bytes than a shard, would outgrow its shard. Its stretches are halved by how far a window reaches before its anchor, and
dealt out by the bytes that all windows of such a half share, which hold more than the anchor. Equal halves count once, one
met once is done, and halves that are still too many are halved again; a window alone is shared whole, so this ends. An
anchor with a good part of a shard's bytes has a shard of its own. Nothing is capped.

Defined results: a null text is the empty text; texts shorter than a window lose nothing; rows with a null id come
first, as one id; rows that share id and text count once and get the same result each; rows that share an id but not
the text are ordered by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from weekwatch.llm.suffix_array import repeated_windows
from weekwatch.llm.worker import release
from weekwatch.session import stored

#: Bytes of a gram, bytes of a shard, different stretches of an anchor beyond which they are halved.
GRAM, SHARD_BYTES, MANY = 32, 2_000_000, 4_000
#: Places of documents that share an id are kept apart by this many bits.
_COPY_BITS = 36
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in each run of ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _gram_values(octets: bytes, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place."""
    data = np.frombuffer(octets, dtype=np.uint8)
    value, factor, done = data.astype(np.uint64) + np.uint64(1), np.array([_MIX]), 1
    whole, have = None, 0  # value of ``done`` bytes from each place; ``whole`` gathers the powers of two in ``gram``
    while True:
        if gram & done:
            whole = value if whole is None else whole[: len(value) - have] * factor + value[have:] if have else value
            have += done
        if done * 2 > gram:
            break
        value = value[:-done] * factor + value[done:]
        factor, done = factor * factor, done * 2
    value = whole[: len(data) - gram + 1].copy()
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def anchors(octets: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: anchor, first window, number of windows, whether its gram may repeat."""
    gram = min(GRAM, width)
    if len(octets) < width:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    value = _gram_values(octets, gram)
    span = width - gram + 1
    anchor = _least(value, span)
    start = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
    count = np.diff(np.append(start, len(anchor)))
    own = anchor[start]
    # a gram is chosen if some window that holds it has its value as anchor
    most = ~_least(~np.concatenate((np.zeros(span - 1, np.uint64), anchor, np.zeros(span - 1, np.uint64))), span)
    chosen = np.sort(value[most == value])
    twice = chosen[1:][chosen[1:] == chosen[:-1]]
    return own.view(np.int64), start, count, np.isin(own, twice)


def halves(octets: bytes, m: int, lo: int, hi: int, width: int) -> tuple[list[tuple], list[list[int]]]:
    """Parts of a stretch whose windows start ``lo`` to ``hi`` - 1 bytes before their first gram of the anchor ``m``.

    A part is a run of windows with that gram at one place and a start in one half of the range: its range, hashes of
    what its windows share and of all its bytes, first window, number of windows. Equal windows are in parts that share
    the same bytes. Parts that repeat an earlier one are given as runs of windows only.
    """
    places = np.flatnonzero(_gram_values(octets, min(GRAM, width)).view(np.int64) == m)
    window = np.arange(len(octets) - width + 1)
    place = places[np.searchsorted(places, window)]
    middle = (lo + hi) // 2
    upper = place - window >= middle
    start = np.append(0, np.flatnonzero((place[1:] != place[:-1]) | (upper[1:] != upper[:-1])) + 1)
    parts, known, seen = [], [], set()
    for a, b, p, far in zip(start.tolist(), [*start[1:].tolist(), len(window)], place[start].tolist(), upper[start].tolist()):
        low, high = (middle, hi) if far else (lo, middle)
        shared = xxhash.xxh3_64_intdigest(octets[p - low : p - high + 1 + width], seed=low << 32 | high)
        whole = xxhash.xxh3_64_intdigest(octets[a : b + width - 1])
        if (shared, whole) not in seen:
            seen.add((shared, whole))
            parts.append((low, high, shared - (1 << 63), whole - (1 << 63), a, b - a))
        elif known and sum(known[-1]) == a:
            known[-1][1] += b - a
        else:
            known.append([a, b - a])
    return parts, known


#: Parts of stretches: shard, or hash of what the windows share; hash of the bytes, null if the part is not to be halved;
#: anchor, range of starts, place of the first window, windows, bytes. Windows that are repeats for certain have no ``g``.
_PARTS = "g long, s long, m long, lo int, hi int, doc long, at long, n int, piece binary"


def _part_frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows of ``_PARTS`` as frames of bounded size."""
    names = [c.split()[0] for c in _PARTS.split(", ")]

    def frame(out: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(names, zip(*out)))
        return pd.DataFrame(columns | {c: pd.array(columns[c], dtype="Int64") for c in "gs"})  # 64 bits do not fit a float

    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1] or b"")
        if len(out) >= 20_000 or size >= SHARD_BYTES:
            yield frame(out)
            out, size = [], 0
    if out:
        yield frame(out)


def _part_rows(octets: bytes, m: int, lo: int, hi: int, doc: int, at: int, width: int) -> Iterator[tuple]:
    parts, known = halves(octets, m, lo, hi, width)
    for low, high, g, s, a, n in parts:
        yield g, s, m, low, high, doc, at + a, n, octets[a : a + n + width - 1]
    for a, n in known:
        yield None, None, m, 0, 0, doc, at + a, n, None


def _packed(text: str) -> Column:
    """The text as compressed bytes, which is what is shuffled."""

    @F.pandas_udf("binary")
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in texts:
            yield pd.Series([press.compress(t.encode("utf-8", "replace")) for t in batch])

    return pack(text)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _anchor_rows(df: DataFrame, width: int) -> DataFrame:
    """Each anchor as often as stretches have it, and once more where its gram may repeat inside."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            for part in range(0, len(pdf), 1000):
                out = [np.empty(0, dtype=np.int64)]
                for text in pdf["text"].iloc[part : part + 1000]:
                    anchor, _, _, again = anchors(text.encode("utf-8", "replace"), width)
                    out += [anchor, anchor[again]]
                yield pd.DataFrame({"m": np.concatenate(out)})

    return df.select("text").mapInPandas(rows, "m long")


def _stretches(df: DataFrame, width: int) -> DataFrame:
    """``(m, s, doc, at, n, again)``: anchor, hash of the stretch, place of its first window, windows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            for part in range(0, len(pdf), 500):
                out = []
                for doc, copy, text in pdf.iloc[part : part + 500].itertuples(index=False):
                    octets = text.encode("utf-8", "replace")
                    anchor, start, count, again = anchors(octets, width)
                    ends = (start + count + width - 1).tolist()
                    hashes = np.array([digest(octets[a:b]) for a, b in zip(start.tolist(), ends)], dtype=np.uint64)
                    out.append((anchor, hashes.view(np.int64), np.full(len(start), doc),
                                start + (int(copy) << _COPY_BITS), count.astype(np.int32), again))
                yield pd.DataFrame(dict(zip(("m", "s", "doc", "at", "n", "again"), map(np.concatenate, zip(*out)))))

    return df.select("doc", "copy", "text").mapInPandas(
        rows, "m long, s long, doc long, at long, n int, again boolean")


def _by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of a document as one array for each column, which its length bounds; arrays of numbers reach Python as
    such, without an object for each row."""
    copy = F.shiftright("at", _COPY_BITS).cast("int")
    place = F.col("at") - F.shiftleft(F.shiftright("at", _COPY_BITS), _COPY_BITS)
    lists = rows.withColumn("copy", copy).withColumn("at", place).groupBy("doc", "copy").agg(
        F.collect_list(F.struct("at", *columns)).alias("rows"))
    return lists.select("doc", "copy", *[F.col("rows")[c].alias(c) for c in ("at", *columns)])


def marks(docs: DataFrame, width: int) -> DataFrame:
    """``(doc, at, n)``: runs of windows that also start earlier. ``docs`` has ``doc, copy, text``, each pair once."""
    repeated = _anchor_rows(docs, width).groupBy("m").count().filter("count > 1").select("m")
    found = stored(_stretches(docs, width).join(repeated, "m"))
    here = F.struct("doc", "at")
    different = stored(found.groupBy("m", "s").agg(
        F.min(here).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.max("again").alias("again")))
    copies = found.join(different.filter("copies > 1").select("m", "s", "first"), ["m", "s"]).filter(
        here != F.col("first")).select("doc", "at", "n")

    per_anchor = different.groupBy("m").agg(
        F.count("*").alias("kinds"), F.sum(F.col("n").cast("long") + width - 1).alias("octets"))
    too_many = (F.col("kinds") > MANY) | (F.col("octets") > SHARD_BYTES)
    rivals = different.join(per_anchor, "m").filter("kinds > 1 OR again").select(
        "m", "first.doc", "first.at", "n", too_many.alias("many"), (F.col("octets") > SHARD_BYTES // 4).alias("own"))
    rivals = stored(rivals)
    shard = F.when(F.col("own") | F.col("many"), F.col("m")).otherwise(F.pmod("m", _shards(rivals, width)))
    wanted = _by_document(rivals.withColumn("g", shard), "g", "n", "many").join(
        docs.select("doc", "copy", _packed("text").alias("packed")), ["doc", "copy"])
    span = width - min(GRAM, width) + 1

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for pdf in batches:
                columns = (pdf[c] for c in ("doc", "copy", "g", "at", "n", "many", "packed"))
                for doc, copy, *lists, packed in zip(*columns):
                    text, shift = _unpack(packed), int(copy) << _COPY_BITS
                    for g, at, n, too_many in zip(*(x.tolist() for x in lists)):
                        piece = text[at : at + n + width - 1]
                        if too_many:
                            yield from _part_rows(piece, g, 0, span, doc, at + shift, width)
                        else:
                            yield g, None, g, 0, 0, doc, at + shift, n, piece

        yield from _part_frames(rows())

    pieces = wanted.mapInPandas(cut, _PARTS)
    lonely = rivals.filter("many").isEmpty()
    pieces = pieces if lonely else stored(pieces)
    ready = pieces.filter("s IS NULL AND g IS NOT NULL").select("g", "doc", "at", "piece")
    if not lonely:
        repeats, more = _halved(pieces.filter("s IS NOT NULL"), width)
        copies = copies.union(pieces.filter("g IS NULL").select("doc", "at", "n")).union(repeats)
        ready = ready.union(more)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = list(zip(pdf["doc"].tolist(), pdf["at"].tolist()))
        out = []
        for (doc, at), later in zip(keys, repeated_windows(pdf["piece"].tolist(), keys, width)):
            if len(later):
                starts = np.flatnonzero(np.diff(later, prepend=-2) > 1)
                out += [(doc, at + int(later[a]), b - a) for a, b in zip(starts, [*starts[1:], len(later)])]
        return pd.DataFrame(out, columns=["doc", "at", "n"])

    return copies.union(ready.groupBy("g").applyInPandas(compare, "doc long, at long, n int"))


def _shards(rivals: DataFrame, width: int) -> Column:
    """Number of shards for the rows that are not too many."""
    octets = rivals.agg(F.sum(F.when(~F.col("many"), F.col("n").cast("long") + width - 1))).first()[0] or 0
    return F.lit(max(1, int(octets) // SHARD_BYTES)).cast("long")


def _halved(parts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``(doc, at, n)`` of windows in copies of a part, and ``(g, doc, at, piece)`` of the different ones in shards."""
    here, level, repeats, ready = F.struct("doc", "at"), 0, [], []

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _part_frames(row for pdf in batches for m, lo, hi, doc, at, piece in pdf.itertuples(index=False)
                                for row in _part_rows(piece, m, lo, hi, doc, at, width))

    while True:
        level += 1
        different = stored(parts.groupBy("g", "s").agg(
            F.min(here).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("m", "lo", "hi", "n", "piece")]))
        repeats.append(parts.join(different.filter("copies > 1").select("g", "s", "first"), ["g", "s"]).filter(
            here != F.col("first")).select("doc", "at", "n"))
        per_half = different.groupBy("g").agg(
            F.count("*").alias("kinds"), F.sum(F.col("n").cast("long") + width - 1).alias("octets"))
        too_many = (F.col("kinds") > MANY) | (F.col("octets") > SHARD_BYTES)
        rivals = stored(different.join(per_half.filter("kinds > 1"), "g").select(
            "g", "m", "lo", "hi", "first.doc", "first.at", "n", "piece", too_many.alias("many")))
        ready.append(rivals.filter("NOT many").select(
            F.xxhash64(F.lit(level), F.pmod("g", _shards(rivals, width))).alias("g"), "doc", "at", "piece"))
        many = rivals.filter("many").select("m", "lo", "hi", "doc", "at", "piece")
        if many.isEmpty():
            return reduce(DataFrame.union, repeats), reduce(DataFrame.union, ready)
        done = stored(many.mapInPandas(halve, _PARTS))
        repeats.append(done.filter("g IS NULL").select("doc", "at", "n"))
        parts = done.filter("s IS NOT NULL")


def _numbered(named: DataFrame) -> DataFrame:
    """Adds ``_copy``: the number of a text among the different texts of its id, in the order of their 128-bit hashes.

    Texts of an id are dealt out by the first digits of their hash, so an id that many rows share fills no task.
    """
    named = named.withColumn("_hash", F.md5("_text"))
    texts = named.select("_doc", "_hash", F.substring("_hash", 1, 3).alias("_deal")).distinct()
    before = Window.partitionBy("_doc").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = texts.groupBy("_doc", "_deal").count().select("_doc", "_deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_doc", "_deal").orderBy("_hash"))
    numbers = texts.join(offsets, ["_doc", "_deal"]).select("_doc", "_hash", (place + F.col("_before")).cast("int").alias("_copy"))
    return named.join(stored(numbers), ["_doc", "_hash"]).drop("_hash")


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 100,
                   whole_characters: bool = False) -> DataFrame:
    """All columns of ``df`` but the text, with ``n_bytes``, ``spans`` (removed byte runs, each from start to stop) and
    ``kept`` (the remaining bytes), which replace columns of these names. With ``whole_characters`` ``kept`` is a text,
    and a character that was cut in two goes as a whole."""
    kept = [c for c in df.columns if c not in ("n_bytes", "spans", "kept", text)]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])  # so that no name of the input meets one of those below
    named = df.select(row.alias("_row"), F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(-(2**63))).alias("_doc"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    shared = not named.groupBy("_doc").count().filter("count > 1").isEmpty()
    named = _numbered(named) if shared else named.withColumn("_copy", F.lit(0))
    docs = named.select(F.col("_doc").alias("doc"), F.col("_copy").alias("copy"), F.col("_text").alias("text"))
    runs = _by_document(marks(docs.dropDuplicates(["doc", "copy"]) if shared else docs, width), "n")

    # the text is made here: a second Python function in the stage would keep a second worker for each task
    @F.pandas_udf(f"n_bytes long, start array<long>, stop array<long>, kept {'string' if whole_characters else 'binary'}")
    def remove(packed: pd.Series, at: pd.Series, count: pd.Series) -> pd.DataFrame:
        out = []
        for p, places, counts in zip(packed, at, count):
            octets, spans = _unpack(p), []
            for a, n in sorted(zip(places.tolist(), counts.tolist())) if places is not None else ():
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], a + n + width - 1)
                else:
                    spans.append([a, a + n + width - 1])
            edges = [0, *(e for s in spans for e in s), len(octets)]
            rest = b"".join(octets[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rest = rest.decode("utf-8", "ignore") if whole_characters else rest
            out.append((len(octets), edges[1:-1:2], edges[2:-1:2], rest))
        return pd.DataFrame(out, columns=["n_bytes", "start", "stop", "kept"])

    slim = named.select("_row", "_doc", "_copy", _packed("_text").alias("_packed"))
    runs = runs.select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), F.col("at").alias("_at"), F.col("n").alias("_n"))
    done = slim.join(runs, ["_doc", "_copy"], "left").withColumn("_r", remove("_packed", "_at", "_n"))
    spans = F.arrays_zip(F.col("_r.start").alias("start"), F.col("_r.stop").alias("stop")).alias("spans")
    return done.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_r.n_bytes"), spans, F.col("_r.kept"))

"""SimHash near-duplicates with pivot distance tables.

Texts become 64-bit fingerprints. A table of Hamming distances to many reference fingerprints (pivots) turns the search
into coordinates: two fingerprints within ``bits`` of each other differ by at most ``bits`` in every coordinate, so a
pair is discarded as soon as one differs by more, and only survivors are verified bit by bit.

Pivot coordinates alone would make every task compare with nearly every other, so equal bit blocks deal out the
fingerprints first: with ``bits + 1`` blocks, one block of any linked pair is equal. A block value with too many
fingerprints is split by blocks of its remaining bits, which again loses no pair. Equal fingerprints are one node.

Defined results: a null text is the empty text; a text without words has fingerprint zero, linked like any other; rows
with a null id take part but never name a component; repeated rows come back once each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from weekwatch.llm.components import components
from weekwatch.session import stored

#: Reference fingerprints, fingerprints dealt to one group, fingerprints of a block value before it is split again.
PIVOTS, GROUP_ROWS, SPLIT_ROWS, SPLIT_LEVELS = 24, 40_000, 3_000, 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3, at_once: int = 200_000) -> int:
    """SimHash of ``width``-word shingles as an unsigned number; words are runs of non-space, A-Z in lower case."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    stops = [*spaces.tolist(), len(joined)][min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    counts, n = np.zeros(64, dtype=np.int64), len(stops)
    for part in range(0, n, at_once):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[part : part + at_once], stops[part : part + at_once])]
        octets = np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 8)
        if len(octets) < 400:
            counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """Adds the fingerprint of the whole text, as a signed long with the same 64 bits."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, width) for t in batch], dtype=np.uint64).view(np.int64))

    return df.withColumn(out, simhash(F.coalesce(F.col(text), F.lit(""))))


def references(pivots: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints that depend on no data."""
    return np.array([xxhash.xxh64_intdigest(b"pivot", i) for i in range(pivots)], dtype=np.uint64)


def pivot_table(values: np.ndarray, pivots: int = PIVOTS, reference: np.ndarray | None = None) -> np.ndarray:
    """Hamming distance of each 64-bit value to each reference fingerprint."""
    reference = references(pivots) if reference is None else reference
    return np.bitwise_count(values[:, None] ^ reference[None, :]).astype(np.int8)


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of ``a[i]`` and ``b[i]``; a label is the smallest index of its class."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def link_group(keys: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """For each value the smallest index linked to it, through pairs of equal key within ``bits``."""
    table = pivot_table(values)
    order = np.lexsort((table[:, 0], keys))
    keys, ordered, table = keys[order], values[order], table[order]
    labels, at, step = np.arange(len(keys)), np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        near = (keys[at + step] == keys[at]) & (table[at + step, 0] - table[at, 0] <= bits)
        at = at[near]  # sorted by the first coordinate: beyond a gap there is nothing nearer
        if not len(at):
            break
        left = at[np.abs(table[at] - table[at + step]).max(axis=1) <= bits]
        left = left[np.bitwise_count(ordered[left] ^ ordered[left + step]) <= bits]
        if len(left):
            labels = _unite(labels, left, left + step)
        step += 1
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = order[labels]
    return out


def _blocks(rows: DataFrame, bits: int) -> DataFrame:
    """One copy of each row for each block of its remaining bits; ``key`` names the blocks passed, ``rest`` their bits."""
    per = F.ceil(F.col("free") / (bits + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda b: F.struct(
        b.alias("b"), F.expr("0").alias("x")))
    rows = rows.select("fp", "key", "rest", "free", per.alias("per"), F.explode(parts).alias("p"))
    lo = F.col("p.b") * F.col("per")
    size = F.greatest(F.least(F.col("per"), F.col("free") - lo), F.lit(0))
    mask = F.expr("shiftleft(1L, size) - 1")
    rows = rows.withColumn("lo", lo).withColumn("size", size).withColumn(
        "value", F.expr("shiftrightunsigned(rest, lo)").bitwiseAND(mask))
    rest = F.expr("(rest & (shiftleft(1L, lo) - 1)) | shiftleft(CASE WHEN lo + size >= 64 THEN 0L ELSE "
                  "shiftrightunsigned(rest, lo + size) END, lo)")
    return rows.select("fp", F.xxhash64("key", "p.b", "value").alias("key"), rest.alias("rest"),
                       (F.col("free") - F.col("size")).alias("free"))


def links(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """Edges ``(u, v)`` that join all fingerprints within ``bits`` of each other, a spanning set of each block value."""
    rows = _blocks(nodes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"),
                                F.lit(64).alias("free")), bits)
    found = None
    for level in range(1, SPLIT_LEVELS + 1):
        rows = stored(rows)
        sizes = rows.groupBy("key").count().filter("count > 1")
        few = sizes if level == SPLIT_LEVELS else sizes.filter(F.col("count") <= SPLIT_ROWS)
        dealt = rows.join(few.select("key"), "key")
        groups = max(1, rows.count() // GROUP_ROWS)

        def link(pdf: pd.DataFrame) -> pd.DataFrame:
            values = pdf["fp"].to_numpy().view(np.uint64)
            root = link_group(pdf["key"].to_numpy(), values, bits)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pd.DataFrame({"u": pdf["fp"].to_numpy()[moved], "v": pdf["fp"].to_numpy()[root[moved]]})

        edges = dealt.select("fp", "key", F.pmod(F.col("key"), F.lit(groups)).alias("g")).groupBy("g").applyInPandas(
            link, "u long, v long")
        found = edges if found is None else found.union(edges)
        hot = sizes.filter(F.col("count") > SPLIT_ROWS)
        if level == SPLIT_LEVELS or hot.isEmpty():
            break
        rows = _blocks(rows.join(hot.select("key"), "key"), bits)
    return found


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3,
                    bits: int = 2) -> DataFrame:
    """``(id, fp, component_id)`` for every row: fingerprints within ``bits`` link, and ``component_id`` is the
    smallest id reachable over links."""
    own = stored(fingerprints(df.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "text", width)
                 .select("id", "fp"))
    nodes = stored(own.groupBy("fp").agg(F.min("id").alias("first")))
    class_of = components(links(nodes, bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(class_of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def hex_digits(fp: str):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

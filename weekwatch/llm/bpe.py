"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pre-tokens are doubly linked lists of byte positions. Every adjacent pair whose joined bytes are a token waits in the
bucket of that token's rank; a bitmap of three levels names the lowest non-empty bucket by find-first-set, so the next
merge costs three word operations however long a pre-token is. Entries whose pair has changed are skipped as stale.
All new pre-tokens of a batch share one queue: they do not touch each other, so a bucket is merged as one array.

Defined results: a null text is the empty text (no ids, digests of the empty string); repeated rows are encoded each
for itself; all input columns stay.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from weekwatch.llm.worker import held

#: Pre-tokens remembered by a Python worker before it starts again; bounds its memory, never the result.
CACHE_PIECES = 300_000
#: Bytes of new pre-tokens merged in one queue, characters split into pre-tokens at a time, rows of an Arrow batch.
QUEUE_BYTES, SPLIT_CHARS, BATCH_ROWS = 2_000_000, 3_000_000, 1_000


class RankQueue:
    """Buckets of positions by rank; a bit of ``low`` tells that a bucket has entries, ``mid`` and ``top`` sum up."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put each position into the bucket of its rank; negative ranks have none."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        firsts = ranks[starts].tolist() if len(ranks) else []
        for rank, a, b in zip(firsts, starts, [*starts[1:], len(ranks)]):
            if rank < 0:
                continue
            if rank in self.buckets:
                self.buckets[rank].append(positions[a:b])
                continue
            self.buckets[rank] = [positions[a:b]]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and its positions in ascending order; call while ``top`` is not 0."""
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        chunks = self.buckets.pop(rank)
        return rank, chunks[0] if len(chunks) == 1 else np.unique(np.concatenate(chunks))


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.top_rank = max(self.ranks.values())
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                x, y = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if x is not None and y is not None:
                    pairs[x << 32 | y] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where their bytes are no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge(self, pieces: list[bytes], whole_buckets: bool = True) -> list[list[int]]:
        """Ids of each pre-token.

        Merging a whole bucket equals merging its positions one by one unless a new pair ranks below the bucket. Such
        pre-tokens (rare in trained vocabularies) are done again with one merge of each pre-token at a time.
        """
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        stops = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate(([0], stops[:-1]))
        token, alive = self.byte_id[data], np.ones(n, dtype=bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[starts] = -1
        last = np.zeros(n, dtype=bool)
        last[stops - 1] = True
        waiting = np.full(n, -1, dtype=np.int64)
        inner = np.flatnonzero(~last)
        waiting[inner] = self.pair_ranks(token[inner], token[inner + 1])
        again: set[int] = set()
        queue = RankQueue(self.top_rank + 1)
        queue.push(waiting[inner], inner)
        while queue.top:
            rank, at = queue.pop()
            at = at[waiting[at] == rank]
            if not whole_buckets and len(at):  # the leftmost of each pre-token, the others wait
                own = np.searchsorted(starts, at, side="right")
                first = np.concatenate(([True], own[1:] != own[:-1]))
                queue.push(np.full(len(at) - first.sum(), rank), at[~first])
                at = at[first]
            if len(at) > 1:  # of overlapping pairs the first, third, ... from the left
                linked = np.concatenate(([False], at[1:] == after[at[:-1]]))
                if linked.any():
                    index = np.arange(len(at))
                    at = at[(index - np.maximum.accumulate(np.where(linked, 0, index))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            after[at], token[at], last[at] = end, rank, last[gone]
            alive[gone], waiting[gone] = False, -1
            more = ~last[at]
            before[end[more]] = at[more]
            left = before[at]
            touched = np.concatenate((left[left >= 0], at))
            new = np.full(len(touched), -1, dtype=np.int64)
            some = ~last[touched]
            new[some] = self.pair_ranks(token[touched[some]], token[after[touched[some]]])
            waiting[touched] = new
            if whole_buckets and (early := (new >= 0) & (new < rank)).any():
                again.update(np.searchsorted(starts, touched[early], side="right").tolist())
            queue.push(new, touched)
        ids = token[alive].tolist()
        cuts = np.concatenate(([0], np.cumsum(np.add.reduceat(alive, starts)))).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        redo = [i - 1 for i in sorted(again)]
        for i, careful in zip(redo, self.merge([pieces[i] for i in redo], False) if redo else []):
            out[i] = careful
        return out

    def learn(self, pieces: set[str]) -> None:
        """Remember each new pre-token: its ids, these as decimals, and the bytes they decode to."""
        new, size = [], 0
        for piece in pieces:
            new.append(piece)
            size += len(piece)
            if size >= QUEUE_BYTES:
                self._learn(new)
                new, size = [], 0
        self._learn(new)

    def _learn(self, new: list[str]) -> None:
        if new:
            for piece, ids in zip(new, self.merge([p.encode("utf-8", "replace") for p in new])):
                self.known[piece] = (tuple(ids), " ".join(map(str, ids)), self.decode(ids))

    def encode_batch(self, texts: list[str]) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """For each text what ``learn`` holds of its pre-tokens, in order; ordinary text, no special tokens."""
        held, new, chars = [], set(), 0
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        for i, text in enumerate(texts):
            held.append(self.find.findall(text))
            new |= set(held[-1]).difference(self.known)
            chars += len(text)
            if chars < SPLIT_CHARS and i < len(texts) - 1:
                continue
            self.learn(new)
            for pieces in held:
                yield list(map(self.known.__getitem__, pieces))
            held, new, chars = [], set(), 0

    def encode(self, text: str) -> list[int]:
        return [i for got in next(self.encode_batch([text])) for i in got[0]]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _small_batches(df: DataFrame) -> None:
    """Ids take about as much memory as their text, so a task gets fewer rows at a time than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key, "10000")) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))


def codec(rank_file: str, pattern: str) -> Codec:
    """The worker's codec for these ranks."""
    return held(("bpe", rank_file, pattern), lambda: Codec(rank_file, pattern))


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the token ids of the whole text. The rank file is read where the task runs."""
    _small_batches(df)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(rank_file, pattern)
        for batch in texts:
            yield pd.Series([np.array([i for got in pieces for i in got[0]], dtype=np.int32)
                             for pieces in own.encode_batch(batch.tolist())])

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for; null ids are no ids."""

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(rank_file, pattern)
        for batch in batches:
            yield pd.Series([own.decode(i) if i is not None else b"" for i in batch])

    return df.withColumn(out, back(F.col(ids)))


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """Encode, then decode the ids: adds ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and
    ``decoded_sha256`` in one pass over the texts; ``ids`` names a column to keep the ids in."""
    kept = ", ids array<int>" if ids else ""
    _small_batches(df)

    @F.pandas_udf(f"n_tokens long, ids_sha256 string, decoded_sha256 string{kept}")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(rank_file, pattern)
        for batch in texts:
            rows = []
            for pieces in own.encode_batch(batch.tolist()):
                joined = (" ".join([p[1] for p in pieces]).encode(), b"".join([p[2] for p in pieces]))
                digests = [hashlib.sha256(b).hexdigest() for b in joined]
                row = (sum([len(p[0]) for p in pieces]), *digests)
                rows.append((*row, np.array([i for p in pieces for i in p[0]], dtype=np.int32)) if ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if ids else []))

    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ([ids] if ids else [])
    source = both(F.coalesce(F.col(text), F.lit("")))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return df.select(*rest, source.alias("_bpe")).select(
        *[f"`{c}`" for c in df.columns if c not in made],
        F.col("_bpe.n_tokens"), F.col("_bpe.ids_sha256"), F.col("_bpe.decoded_sha256"),
        *([F.col("_bpe.ids").alias(ids)] if ids else []),
    )

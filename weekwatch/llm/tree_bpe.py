"""Byte-level BPE by tree concatenation, with the ids of a ``tokenizers`` file.

A pre-token (a stretch that the pattern leaves unsplit) of more than ``LEAF`` bytes is cut into leaves that are encoded
each for itself; neighbours are then concatenated level by level. At a join, a window of tokens on both sides is encoded
again from its bytes. If its first and last token are the ones that stood there before, both sides agree; otherwise the
window doubles. Agreement is a proof: merges take the lowest rank first, the leftmost of equals, so ids are the encoding
of their bytes exactly if every pair of neighbours is the encoding of its own bytes, and such pairs lie inside the left
part, the window or the right part.

Texts of ``SPREAD`` characters or more are spread over tasks: their leaves become rows, are encoded in parallel and
joined two by two in shuffles, so one long text does not keep one task busy.

Defined results: a null text is the empty text (no ids, digests of the empty string); repeated rows are encoded each for
itself; all input columns stay, except those named like an output, which are replaced; an empty table gives an empty
table. Texts of special tokens stand for their ids. Added tokens with stripping or word limits are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from weekwatch.llm.worker import held
from weekwatch.session import stored

#: Bytes of a leaf inside a task, tokens on each side of a first window, bytes up to which the plain loop encodes.
LEAF, WINDOW, SHORT = 64, 4, 256
#: Characters from which a text is spread over tasks, and bytes of the leaves it is spread in.
SPREAD, SPREAD_LEAF = 65_536, 16_384
#: Pre-tokens remembered by a Python worker before it starts again; bounds its memory, never the result.
CACHE_PIECES = 300_000

#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Outside these blocks the classes of letters and digits depend on the Unicode version, so the library itself splits.
UNSETTLED = regex.compile(r"[^\x00-Օ‐-‧‰-⁞]")
_NONE = 1 << 60


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Encoder:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, kind = config["model"], config["pre_tokenizer"] or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or config["normalizer"]:
            raise ValueError(f"{path} is not plain byte-level BPE")
        vocab, of = model["vocab"], {c: b for b, c in enumerate(byte_characters())}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.tokens = {i: bytes(map(of.__getitem__, t)) for t, i in vocab.items()}
        self.special: dict[str, int] = {}
        for token in config["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"added token {token['content']!r} has limits that are not supported")
            self.special[token["content"]] = token["id"]
            self.tokens[token["id"]] = token["content"].encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.byte_id = [vocab[c] for c in byte_characters()]
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.known = _Known(self)

    # --- bytes of one pre-token -------------------------------------------

    def plain(self, data: bytes) -> list[int]:
        """Ids of a short or long stretch without a tree: always the merge of lowest rank, the leftmost of equals."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > SHORT:
            return self._queued(ids)
        rank = self.rank
        ranks = [rank.get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < _NONE:
            i = ranks.index(best)
            ids[i:i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _queued(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked positions, for windows that had to grow far."""
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or rank.get(ids[i] << 32 | ids[j], _NONE) != best:
                continue
            ids[i], ids[j] = self.made[best], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(ids[i] << 32 | ids[after[i]], _NONE)) < _NONE:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := rank.get(ids[p] << 32 | ids[i], _NONE)) < _NONE:
                heapq.heappush(heap, (r, p))
        return [i for i in ids if i >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenated bytes of two encodings: grow the window at the join until both sides agree."""
        width = WINDOW
        while left and right:
            a, b = left[-width:], right[:width]
            window = self.plain(self.decode(a) + self.decode(b))
            agreed = (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1])
            if agreed:
                return [*left[:len(left) - len(a)], *window, *right[len(b):]]
            width *= 2
        return [*left, *right]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token: leaves, then joins of neighbours level by level."""
        if len(data) <= LEAF:
            return self.plain(data)
        parts = [self.plain(data[i:i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(parts) > 1:
            joined = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(parts) - len(parts) % 2:]
        return parts[0]

    # --- texts ------------------------------------------------------------

    def _split(self, text: str) -> list[str]:
        if text.isascii() or not UNSETTLED.search(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of the whole text in order; special tokens are pieces of their own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._split(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self._split(part)
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Known(dict):
    """Packed ids of each pre-token met; one that is missing is encoded."""

    def __init__(self, own: Encoder):
        super().__init__()
        self.own = own

    def __missing__(self, piece: str) -> bytes:
        ids = [self.own.special[piece]] if piece in self.own.special else self.own.encode_piece(piece.encode())
        self[piece] = packed = np.array(ids, dtype="<u4").tobytes()
        return packed


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    return held(("tree_bpe", path), lambda: Encoder(path))


def _digest(own: Encoder, packed: bytes, keep: bool) -> tuple:
    ids = np.frombuffer(packed, "<u4")
    decoded = own.decode(ids.tolist()).decode("utf-8", "replace")
    row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    return (*row, ids.astype(np.int32)) if keep else row


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", spread: int = SPREAD, leaf: int = SPREAD_LEAF) -> DataFrame:
    """Adds ``out``: the token ids of the whole text. The tokenizer file is read where the task runs."""
    return _encoded(df, path, text, [(out, "ids array<int>", lambda own, packed: (np.frombuffer(packed, "<i4"),))], spread, leaf)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text that the ids stand for, special tokens included; null ids are no ids."""

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for batch in batches:
            yield pd.Series([own.decode(i).decode("utf-8", "replace") if i is not None else "" for i in batch])

    return df.withColumn(out, back(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str | None = None, spread: int = SPREAD, leaf: int = SPREAD_LEAF) -> DataFrame:
    """Encode, then decode the ids: adds ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (UTF-8); ``ids`` names a column to keep the ids in."""
    made = [("n_tokens", "n_tokens long", None), ("ids_sha256", "ids_sha256 string", None), ("decoded_sha256", "decoded_sha256 string", None)]
    if ids:
        made.append((ids, "ids array<int>", None))
    made[0] = (*made[0][:2], lambda own, packed: _digest(own, packed, bool(ids)))
    return _encoded(df, path, text, made, spread, leaf)


def _encoded(df: DataFrame, path: str, text: str, made: list[tuple[str, str, Callable]], spread: int, leaf: int) -> DataFrame:
    """``df`` with the columns ``made``: (name, type, function of encoder and packed ids; the first one's gives a row)."""
    names, kind, result = [m[0] for m in made], ", ".join(m[1] for m in made), made[0][2]
    fields = [m[1].split(" ")[0] for m in made]
    kept = [c for c in df.columns if c not in names]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    rows = df.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    @F.pandas_udf(kind)
    def of_texts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for batch in texts:
            yield pd.DataFrame([result(own, own.packed(t)) for t in batch], columns=fields)

    @F.pandas_udf(kind)
    def of_ids(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for batch in batches:
            yield pd.DataFrame([result(own, i.astype("<u4").tobytes()) for i in batch], columns=fields)

    far = F.length("text") >= spread
    long = stored(rows.filter(far).withColumn("key", F.monotonically_increasing_id()))
    spread_ids = _spread(long.select("key", "text"), path, leaf)
    parts = rows.filter(~far).select("row", of_texts("text").alias("made")).unionByName(
        long.select("key", "row").join(spread_ids, "key").select("row", of_ids("ids").alias("made")))
    return parts.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col("made")[f].alias(n) for f, n in zip(fields, names)])


def _leaves(own: Encoder, text: str, size: int) -> Iterator[tuple[bool, list[bytes]]]:
    """The pre-tokens of a text dealt into leaves: whether the first piece goes on the one before it, and the pieces."""
    pieces: list[bytes] = []
    opened, held = False, 0
    for piece in own.pieces(text):
        data = piece.encode()
        if pieces and held + len(data) > size:
            yield opened, pieces
            pieces, opened, held = [], False, 0
        while len(data) > size and piece not in own.special:
            yield opened, [data[:size]]
            data, opened = data[size:], True
        pieces.append(data)
        held += len(data)
    yield opened, pieces


def _spread(long: DataFrame, path: str, leaf: int) -> DataFrame:
    """Ids of each (key, text): leaves in parallel, then joins of siblings, one shuffle a level."""
    node = "key long, at int, opened boolean, n int, head int, tail int, ids array<int>"

    def cut(batches):
        own = encoder(path)
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                for at, (opened, pieces) in enumerate(_leaves(own, text, leaf)):
                    yield pd.DataFrame({"key": [key], "at": [at], "opened": [opened], "pieces": [pieces]})

    def ids_of(batches):
        own = encoder(path)
        for batch in batches:
            for key, at, opened, pieces in batch.itertuples(index=False):
                done = [[own.special[s]] if (s := bytes(p).decode("utf-8", "ignore")) in own.special else own.encode_piece(bytes(p))
                        for p in pieces]
                ids = np.array([i for d in done for i in d], dtype=np.int32)
                yield pd.DataFrame({"key": [key], "at": [at], "opened": [opened], "n": [len(done)],
                                    "head": [len(done[0]) if done else 0], "tail": [len(done[-1]) if done else 0], "ids": [ids]})

    def siblings(pdf):
        pdf = pdf.sort_values("at")
        left = pdf.iloc[0]
        if len(pdf) == 1:
            n, head, tail, ids = left["n"], left["head"], left["tail"], left["ids"]
        else:
            right = pdf.iloc[1]
            ids, n, head, tail = np.concatenate((left["ids"], right["ids"])), left["n"] + right["n"], left["head"], right["tail"]
            if right["opened"]:
                a, b = len(left["ids"]) - left["tail"], right["head"]
                joined = encoder(path).join(left["ids"][a:].tolist(), right["ids"][:b].tolist())
                ids = np.concatenate((left["ids"][:a], np.array(joined, dtype=np.int32), right["ids"][b:]))
                n -= 1
                head = len(joined) if left["n"] == 1 else head
                tail = len(joined) if right["n"] == 1 else tail
        return pd.DataFrame({"key": [left["key"]], "at": [left["at"] // 2], "opened": [left["opened"]], "n": [n], "head": [head],
                             "tail": [tail], "ids": [ids]})

    cuts = stored(long.mapInPandas(cut, "key long, at int, opened boolean, pieces array<binary>"))
    nodes = cuts.repartition("key", "at").mapInPandas(ids_of, node)
    last = cuts.agg(F.max("at")).first()[0] or 0
    for _ in range(int(last).bit_length()):
        nodes = nodes.groupBy("key", F.floor(F.col("at") / 2).alias("up")).applyInPandas(siblings, node)
    return nodes.select("key", "ids")

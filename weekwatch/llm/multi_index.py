"""Hard negatives of embeddings through an inverted multi-index.

Two codebooks, one for each half of the components, give every vector a pair of codewords; the pairs are the cells of
the index. What an inner product can be inside a cell is bounded by two numbers that add up, one for each half: product
with the codeword plus length of the half query times the radius of the codeword's rows. A heap walks through the cells
by falling sums (multi-sequence); it stops when no cell left can reach a score that is still wanted, so results are exact.

Rows are dealt into shards of neighbouring cells, a cell of many rows (one vector that a third of all rows share) over
several; queries are dealt into blocks. Each query searches the shard of its own cell first. What it found there is a
floor, and it goes on only to those other shards whose best bound reaches the floor. Tasks get one shard and one block.

Defined results: rows without id, label or vector, or with a null, non-finite or very large component (2^16 or more in
size; sums could overflow) take no part. Rows that repeat in id, label and vector count once; a row never is the partner
of an anchor with its id. A shorter vector counts as filled up with zeros. Ties go to the smaller id. Anchors without
positives, or without negatives in the window, give no rows; so does an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weekwatch.session import stored

#: Rows that codebooks are fitted to; every row is indexed. Rounds of fitting.
SAMPLE, ROUNDS = 8_192, 12
#: Rows of a shard (a share of the table between these), anchors of a block.
SHARD_ROWS, SHARES, BLOCK_QUERIES = (2_048, 65_536), 64, 4_096
#: Components of this size or more take no part.
LARGEST = 65_536.0

_FOUND = "qid long, w int, id long, score long"


class Codebooks:
    """Codewords of both halves, radii of their rows, and the bound of each half for a query."""

    def __init__(self, sample: np.ndarray, words: int):
        self.dim, self.half = sample.shape[1], (sample.shape[1] + 1) // 2
        self.centres = [_centres(part, words) for part in self.halves(sample)]
        self.radii = [np.zeros(len(c)) for c in self.centres]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    def nearest(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Codeword and distance to it, for each half."""
        return [_nearest(part, centres) for part, centres in zip(self.halves(x), self.centres)]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and codeword the largest inner product of the halves, rounding included."""
        out = []
        for part, centres, radii in zip(self.halves(queries), self.centres, self.radii):
            length = np.linalg.norm(part, axis=1)[:, None]
            reach = length * radii + 1e-9 * length * (np.linalg.norm(centres, axis=1) + radii) + 1e-3
            out.append(part @ centres.T + reach)
        return out[0], out[1]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.empty(len(x), dtype=np.int64)
    for i in range(0, len(x), 4_096):
        at[i:i + 4_096] = np.argmin((centres**2).sum(1) - 2 * x[i:i + 4_096] @ centres.T, axis=1)
    return at, np.linalg.norm(x - centres[at], axis=1)


def _centres(x: np.ndarray, words: int) -> np.ndarray:
    """Codewords by k-means from evenly spread rows; a codeword without rows stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, min(words, len(x))).astype(int)].astype(np.float64)
    for _ in range(ROUNDS):
        at, _ = _nearest(x, centres)
        for k in np.unique(at):
            centres[k] = x[at == k].mean(axis=0)
    return centres


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows of numbers, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def multi_sequence(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs by falling sum of ``u[i] + v[j]``."""
    left, right = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    u, v = u[left].tolist(), v[right].tolist()
    heap = [(-u[0] - v[0], 0, 0)]
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield -bound, left[x], right[y]
        if y + 1 < len(v):
            heapq.heappush(heap, (-u[x] - v[y + 1], x, y + 1))
        if y == 0 and x + 1 < len(u):
            heapq.heappush(heap, (-u[x + 1] - v[0], x + 1, 0))


class Shard:
    """The rows of one shard by cell, and the certified search in them."""

    def __init__(self, rows: pd.DataFrame, books: Codebooks):
        rows = rows.sort_values(["i", "j"], kind="stable")
        self.books, self.x = books, matrix(rows["v"], books.dim)
        self.ids, self.labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy()
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        self.cells = {(a, b): (x, y) for a, b, x, y in zip(i[first].tolist(), j[first].tolist(), first.tolist(), [*first[1:].tolist(), len(i)])}
        self.i, self.j = np.unique(i), np.unique(j)
        self.size = float(np.abs(self.x).max(initial=0))

    def scores(self, x: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Integer inner products; in floating point only where that is exact."""
        if self.size * np.abs(query).max(initial=0) * self.books.dim < 2**53:
            return (x @ query).astype(np.int64)
        return x.astype(np.int64) @ query.astype(np.int64)

    def search(self, query: np.ndarray, own: int, label, same: bool, windows: list[tuple[int, int]], k: int) -> tuple[list, int]:
        """For each window the first ``k`` rows with scores in it, as (-score, id), and the number of cells visited."""
        u, v = (b[0] for b in self.books.bounds(query[None, :]))
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        floors, visited = [low for low, _ in windows], 0
        for bound, a, b in multi_sequence(u[self.i], v[self.j]):
            if bound < min(floors):
                break
            cell = self.cells.get((int(self.i[a]), int(self.j[b])))
            if cell is None:
                continue
            visited += 1
            rows = slice(*cell)
            score = self.scores(self.x[rows], query)
            good = (score >= min(floors)) & ((self.labels[rows] == label) == same) & (self.ids[rows] != own)
            if not good.any():
                continue
            score, ids = score[good], self.ids[rows][good]
            for w, (_, high) in enumerate(windows):
                fits = (score >= floors[w]) & (score <= high)
                if fits.any():
                    best[w] = heapq.nsmallest(k, [*best[w], *zip((-score[fits]).tolist(), ids[fits].tolist())])
                    if len(best[w]) == k:
                        floors[w] = -best[w][-1][0]
        return best, visited


def _deal(counts: list[int], size: int) -> list[tuple[int, int]]:
    """Lots of about ``size`` for cells in order: (first lot, lots); small neighbours share one, large cells have several."""
    lots, held, out = 0, 0, []
    for n in counts:
        many = math.ceil(n / size)
        if many > 1:
            lots += held > 0
            out.append((lots, many))
            lots, held = lots + many, 0
            continue
        if held and held + n > size:
            lots, held = lots + 1, 0
        out.append((lots, 1))
        held += n
    return out


class Index:
    """Every row in its cell, shard and block."""

    def __init__(self, rows: DataFrame, words: int | None = None, shard_rows: int | None = None, block_queries: int = BLOCK_QUERIES):
        n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        self.empty = not n or not dim and n < 2
        if self.empty:
            return
        words = words or 2 ** min(8, max(2, round(math.log2(n) / 4)))
        shard_rows = shard_rows or min(max(n // SHARES, SHARD_ROWS[0]), SHARD_ROWS[1])
        sample = rows.orderBy(F.xxhash64("id", "rid")).limit(SAMPLE).select("v").toPandas()["v"]
        books = Codebooks(matrix(sample, max(dim, 1)), words)

        @F.pandas_udf("i int, j int, r1 double, r2 double")
        def cell(vectors: pd.Series) -> pd.DataFrame:
            (i, r1), (j, r2) = books.nearest(matrix(vectors, books.dim))
            return pd.DataFrame({"i": i, "j": j, "r1": r1, "r2": r2})

        placed = stored(rows.withColumn("cell", cell("v")).select("*", "cell.*").drop("cell"))
        cells = placed.groupBy("i", "j").agg(
            F.count("*").alias("n"), F.count_if("anchor").alias("queries"), F.max("r1").alias("r1"), F.max("r2").alias("r2"),
        ).orderBy("i", "j").collect()  # words x words rows at most
        for c in cells:
            books.radii[0][c["i"]] = max(books.radii[0][c["i"]], c["r1"])
            books.radii[1][c["j"]] = max(books.radii[1][c["j"]], c["r2"])
        shards, blocks = _deal([c["n"] for c in cells], shard_rows), _deal([c["queries"] for c in cells], block_queries)
        table = [(c["i"], c["j"], *s, *b) for c, s, b in zip(cells, shards, blocks)]
        lots = F.broadcast(rows.sparkSession.createDataFrame(table, "i int, j int, s0 int, sn int, b0 int, bn int"))
        lot = lambda first, many: (F.col(first) + F.pmod(F.xxhash64("rid"), F.col(many))).cast("int")
        self.rows = placed.join(lots, ["i", "j"]).select(
            "rid", "id", "label", "v", "anchor", "i", "j", lot("s0", "sn").alias("shard"), lot("b0", "bn").alias("block"))
        self.books = books
        #: Cells by shard, for the best bound of a shard; a cell of several shards stands in each.
        where = sorted((s0 + d, c["i"], c["j"]) for c, (s0, many) in zip(cells, shards) for d in range(many))
        self.where = np.array(where, dtype=np.int64).reshape(-1, 3)

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """For each row of ``queries`` (qid, id, label, v, shard, block, windows: array of w, low, high) and window the first ``k`` rows."""
        home = self._visit(queries, same, k)
        first = stored(_top(home, k))
        floors = first.groupBy("qid", "w").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
        raised = floors.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("floors"))
        low = lambda x: F.greatest(x["low"], F.coalesce(F.col("floors")[x["w"]], x["low"]))
        windows = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), low(x).alias("low"), x["high"].alias("high")))
        books, where = self.books, self.where
        starts = np.flatnonzero(np.concatenate(([True], where[1:, 0] != where[:-1, 0])))

        @F.pandas_udf("array<int>")
        def reach(vectors: pd.Series, floors: pd.Series, own: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(vectors), 64):
                u, v = books.bounds(matrix(vectors[at:at + 64], books.dim))
                best = np.maximum.reduceat(u[:, where[:, 1]] + v[:, where[:, 2]], starts, axis=1)
                for b, floor, shard in zip(best, floors[at:at + 64], own[at:at + 64]):
                    shards = where[starts[b >= floor], 0]
                    out.append(shards[shards != shard])
            return pd.Series(out)

        onward = queries.join(raised, "qid", "left").withColumn("windows", windows).drop("floors")
        lowest = F.array_min(F.transform("windows", lambda x: x["low"]))
        onward = onward.withColumn("shard", F.explode(reach("v", lowest, "shard")))
        return _top(self._visit(onward, same, k).unionByName(first.drop("place")), k)

    def _visit(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        books = self.books

        def search(rows, asked):
            if not len(rows) or not len(asked):
                return pd.DataFrame({c: [] for c in ("qid", "w", "id", "score")}, dtype="int64")
            shard, out = Shard(rows, books), []
            vectors = matrix(asked["q_v"], books.dim)
            for qid, own, label, windows, query in zip(asked["q_qid"], asked["q_id"], asked["q_label"], asked["q_windows"], vectors):
                best, _ = shard.search(query, own, label, same, [(x["low"], x["high"]) for x in windows], k)
                out += [(qid, x["w"], i, -s) for x, found in zip(windows, best) for s, i in found]
            return pd.DataFrame(out, columns=["qid", "w", "id", "score"])

        asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("qid", "id", "label", "v", "shard", "block", "windows")])
        wanted = asked.select(F.col("q_shard").alias("shard"), F.col("q_block").alias("block")).distinct()
        rows = self.rows.select("shard", "id", "label", "v", "i", "j").join(wanted, "shard")
        return rows.groupBy("shard", "block").cogroup(asked.groupBy("q_shard", "q_block")).applyInPandas(search, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(
    df: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = 256,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, words: int | None = None, shard_rows: int | None = None,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """For each row that is an anchor: its ``positives`` best rows of the same label, and for each of these the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's. Scores are inner
    products of the components ``floor(scale * x)``, higher ones first, ties by id."""
    if not 0 <= low < high:
        raise ValueError("the window needs 0 <= low < high")
    spark, floats = df.sparkSession, F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(floats, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    plain = df.select(
        F.col(f"`{id}`").cast("long").alias("id"), (F.col(f"`{label}`") if isinstance(label, str) else label).alias("label"),
        F.transform(F.when(fine, floats), lambda x: F.floor(x * scale).cast("int")).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = stored(plain.dropna(subset=["id", "label", "v"]).dropDuplicates(["id", "label", "v"]).withColumn("rid", F.monotonically_increasing_id()))
    index = Index(rows, words, shard_rows, block_queries)
    if index.empty:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    window = lambda w, a, b: F.struct(w.cast("int").alias("w"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    anchors = index.rows.filter("anchor").select(F.col("rid").alias("qid"), "id", "label", "v", "shard", "block")
    ends = [F.lit(s * (2**62)) for s in (-1, 1)]
    near = stored(index.search(anchors.withColumn("windows", F.array(window(F.lit(0), *ends))), True, positives))
    below = near.filter("score >= 0").groupBy("qid").agg(F.collect_list(window(
        F.col("place"), F.expr(f"({low} * score + 99) div 100"), F.expr(f"{high} * score div 100"))).alias("windows"))
    hard = index.search(anchors.join(below, "qid"), False, negatives)
    return hard.join(near.select("qid", F.col("place").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["qid", "w"]).join(
        anchors.select("qid", F.col("id").alias("anchor_id")), "qid").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

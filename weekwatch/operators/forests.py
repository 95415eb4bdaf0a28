"""Random forests of all folds, seeds and trees of an experiment at once.

A bootstrap weight is a hash of row, seed and tree, a node's candidate features a hash of seed, tree and node, so a tree
does not depend on where it is grown. Features are cut at quantiles of a fold's own training rows. Two ways lead to the
same trees:

- A fold with few training rows (``local_rows``) goes to tasks whole, one task for each seed and some trees, which grow
  level by level on class histograms of (tree, node, feature, bin).
- A larger fold is dealt into buckets of rows. Each level is one job: buckets count (tree, node, feature, bin) histograms,
  a shuffle adds them up, and the best cuts go back to the buckets. No task ever holds a fold.

Classes are weighted by n / (classes x n_class) of the training rows; a forest's probability is the mean over its trees
of the weighted class shares in a row's leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.classify import CLASSES
from weekwatch.operators.folds import TEST, TRAIN
from weekwatch.session import stored

BINS, TREES, DEPTH = 32, 300, 10
#: Rows a task takes whole, rows of a bucket of a larger fold, trees of a task.
LOCAL_ROWS, BUCKET_ROWS, TASK_TREES = 50_000, 20_000, 100
#: Probabilities are added up as whole numbers of this unit, so sums do not depend on their order.
UNIT = 10**9

_NODE = "_arbol int, _nodo int, _variable int, _corte int, _n_0 long, _n_1 long, _n_2 long"
_HISTOGRAM = "_arbol int, _nodo int, _variable int, _casilla int, _n_0 long, _n_1 long, _n_2 long"
#: Chance of 0, 1, ... draws of a row in a bootstrap sample (Poisson with mean 1).
_DRAWS = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 12.0)))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_keys(seed: int, trees: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(np.full(len(trees), seed % 2**64, dtype=np.uint64)) + trees.astype(np.uint64))


def draws(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each tree (line) draws each row (column)."""
    chance = _mixed(rows.astype(np.int64).view(np.uint64)[None, :] ^ keys[:, None]) / 2.0**64
    return np.searchsorted(_DRAWS, chance).astype(np.int64)


def candidates(keys: np.ndarray, nodes: np.ndarray, n_features: int) -> np.ndarray:
    """Features tried at each node: the square root of their number, ascending."""
    some = max(1, int(n_features**0.5))
    order = _mixed(_mixed(keys ^ _mixed(nodes.astype(np.uint64)))[:, None] + np.arange(n_features, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :some], axis=1)


def best_cuts(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the best candidate and bin of each node by Gini impurity; bin -1 where no cut helps.

    ``counts`` is (node, candidate, bin, class); a cut sends bins up to it to the left.
    """
    left = [np.cumsum(counts[..., k], axis=2) * w for k, w in enumerate(weights)]
    total = [side[:, :, -1:] for side in left]
    right = [t - side for t, side in zip(total, left)]

    def purity(sides):
        size, squares = sum(sides), sum(s * s for s in sides)
        return np.divide(squares, size, out=np.zeros_like(size), where=size > 0), size

    (a, n_left), (b, n_right), (whole, _) = purity(left), purity(right), purity(total)
    gain = np.where((n_left > 0) & (n_right > 0), a + b - whole, -1.0).reshape(len(counts), -1)
    best = np.argmax(gain, axis=1)
    helps = gain[np.arange(len(gain)), best] > 1e-9 * np.maximum(whole[:, 0, 0], 1.0)
    return best // counts.shape[2], np.where(helps, best % counts.shape[2], -1)


class Trees:
    """Nodes of some trees of one forest: children of node k are 2k + 1 (bins up to the cut) and 2k + 2."""

    def __init__(self, depth: int, keys: np.ndarray, classes: int = len(CLASSES)):
        shape = (len(keys), 2 ** (depth + 1) - 1)
        self.depth, self.keys = depth, keys
        self.feature, self.cut = np.full(shape, -1, dtype=np.int16), np.full(shape, -1, dtype=np.int16)
        self.counts = np.zeros((*shape, classes), dtype=np.int64)

    def place(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row (column) in each tree (line) after some levels; rows stay in leaves."""
        at = np.zeros((len(self.keys), len(x)), dtype=np.int64)
        for _ in range(levels):
            at = self.further(x, at)
        return at

    def further(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One level down from where rows are."""
        tree, row = np.arange(len(self.keys))[:, None], np.arange(len(x))[None, :]
        feature = self.feature[tree, at]
        return np.where(feature >= 0, 2 * at + 1 + (x[row, np.maximum(feature, 0)] > self.cut[tree, at]), at)

    def decide(self, tree: np.ndarray, node: np.ndarray, counts: np.ndarray, tried: np.ndarray, weights: np.ndarray, last: bool) -> None:
        """Take the best cuts of one level; ``tried`` are the features of ``counts``'s candidates."""
        self.counts[tree, node] = counts[:, 0].sum(axis=1)
        if not last:
            best, cut = best_cuts(counts, weights)
            self.feature[tree, node] = np.where(cut >= 0, tried[np.arange(len(best)), best], -1)
            self.cut[tree, node] = cut

    def chances(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted class shares of each row's leaf, added up over the trees."""
        out = np.zeros((len(x), self.counts.shape[2]), dtype=np.int64)
        for i in range(0, len(x), 2_000):
            at = self.place(x[i:i + 2_000], self.depth)
            share = self.counts[np.arange(len(self.keys))[:, None], at] * weights
            share /= np.maximum(share.sum(axis=-1, keepdims=True), 1e-300)
            out[i:i + 2_000] = np.rint(share * UNIT).astype(np.int64).sum(axis=0)
        return out


def histograms(trees: Trees, x: np.ndarray, y: np.ndarray, times: np.ndarray, at: np.ndarray, level: int, bins: int, all_rows: bool = False):
    """Class counts of the nodes of one level over some rows: (tree, node, counts, candidates).

    ``times`` and ``at`` are draws and nodes of each row (column) in each tree (line). With ``all_rows`` nodes of one class
    are leaves: their counts are kept in ``trees`` and left out here.
    """
    tree, row = np.nonzero((times > 0) & (at >= 2**level - 1))
    here, own = np.unique(tree << 32 | at[tree, row], return_inverse=True)
    if all_rows:
        classes = trees.counts.shape[2]
        whole = np.bincount(own * classes + y[row], weights=times[tree, row], minlength=len(here) * classes).reshape(-1, classes).astype(np.int64)
        trees.counts[here >> 32, here & 0xFFFFFFFF] = whole
        mixed = (whole > 0).sum(axis=1) > 1
        tree, row, own = tree[mixed[own]], row[mixed[own]], (np.cumsum(mixed) - 1)[own[mixed[own]]]
        here = here[mixed]
    t, node = here >> 32, here & 0xFFFFFFFF
    tried = candidates(trees.keys[t], node, x.shape[1])
    n, some, classes = len(here), tried.shape[1], trees.counts.shape[2]
    counts = np.zeros(n * some * bins * classes)
    w = times[tree, row].astype(np.float64)
    for k in range(some):
        cell = ((own * some + k) * bins + x[row, tried[own, k]]) * classes + y[row]
        counts += np.bincount(cell, weights=w, minlength=len(counts))
    return t, node, counts.reshape(n, some, bins, classes).astype(np.int64), tried


def grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, depth: int, bins: int) -> Trees:
    """Trees on binned rows that fit into memory."""
    trees = Trees(depth, keys)
    step = max(1, 2_000_000 // max(1, len(x)))
    for i in range(0, len(keys), step):
        part = Trees(depth, keys[i:i + step])
        times, at = draws(rows, part.keys), np.zeros((len(part.keys), len(x)), dtype=np.int64)
        for level in range(depth + 1):
            tree, node, counts, tried = histograms(part, x, y, times, at, level, bins, all_rows=True)
            if not len(tree):
                break
            part.decide(tree, node, counts, tried, weights, level == depth)
            at = part.further(x, at)
        trees.feature[i:i + step], trees.cut[i:i + step], trees.counts[i:i + step] = part.feature, part.cut, part.counts
    return trees


def _binned(values: np.ndarray, edges) -> np.ndarray:
    """Number of edges below each value."""
    columns = [np.searchsorted(np.asarray(e), v, side="left") for v, e in zip(values.T, edges)]
    return np.stack(columns, axis=1) if columns else np.zeros(values.shape, dtype=np.int64)


def fold_facts(train: DataFrame, fold: Sequence[str], names: Sequence[str], bins: int = BINS) -> DataFrame:
    """Row per fold: training rows, class weights (0 for an absent class), and edges of the bins of each feature."""
    cuts = [i / bins for i in range(1, bins)]
    edges = [F.array_sort(F.array_distinct(F.percentile_approx(n, cuts, 100_000))) for n in names]
    counts = [F.count_if(F.col("etiqueta") == c) for c in CLASSES]
    present = sum((F.when(c > 0, 1).otherwise(0) for c in counts[1:]), F.when(counts[0] > 0, 1).otherwise(0))
    weights = [F.when(c > 0, F.count("*") / (present * c)).otherwise(0.0) for c in counts]
    return train.groupBy(*fold).agg(
        F.count("*").alias("_n"), present.alias("_clases"), F.array(*weights).alias("_pesos"), F.array(*edges).alias("_bordes"))


def _rows(df: DataFrame, fold: Sequence[str], row: Sequence[str], names: Sequence[str]) -> DataFrame:
    label = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("etiqueta")).cast("int") - 1
    return df.select(*fold, *row, F.xxhash64(*row).alias("_fila"), label.alias("_clase"),
                     F.array(*[F.col(n).cast("double") for n in names]).alias("_x"), "rol")


def fold_predictions(
    assigned: DataFrame,
    names: Sequence[str],
    fold: Sequence[str],
    row: Sequence[str],
    seeds: Sequence[int] = (42,),
    trees: int = TREES,
    depth: int = DEPTH,
    bins: int = BINS,
    local_rows: int = LOCAL_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Predicted class and probabilities of the test rows of every fold and seed.

    ``assigned`` has the columns of ``fold`` and ``row`` (what names a row inside a fold), ``rol``, ``etiqueta`` and the
    predictors ``names``, without nulls. Folds whose training rows have fewer than two classes are not trained: each of
    their test rows comes once, without seed and prediction. Equal chances go to the lower class.
    """
    rows = stored(_rows(assigned, fold, row, names))
    labels = assigned.filter(F.col("rol") == TEST).select(*fold, *row, "etiqueta")
    facts = stored(fold_facts(assigned.filter(F.col("rol") == TRAIN), fold, names, bins))
    able = facts.filter("_clases >= 2")
    small, large = able.filter(F.col("_n") <= local_rows), able.filter(F.col("_n") > local_rows)
    votes = _local(rows, small, fold, row, seeds, trees, depth, bins)
    if not large.isEmpty():
        votes = votes.unionByName(_spread(rows, large, fold, row, seeds, trees, depth, bins, bucket_rows))
    sums = votes.groupBy(*fold, *row, "semilla").agg(*[F.sum(f"_p_{c}").alias(f"_p_{c}") for c in CLASSES])
    best = F.greatest(*[F.col(f"_p_{c}") for c in CLASSES])
    chosen = F.coalesce(*[F.when(F.col(f"_p_{c}") == best, F.lit(c)) for c in CLASSES])
    done = sums.select(*fold, *row, "semilla", chosen.alias("pred"), *[(F.col(f"_p_{c}") / (trees * UNIT)).alias(f"p_{c}") for c in CLASSES])
    return labels.join(able.select(*fold, F.lit(True).alias("_apto")), list(fold), "left").join(
        done, [*fold, *row], "left").filter("_apto IS NULL OR semilla IS NOT NULL").drop("_apto")


def _blocks(facts: DataFrame, seeds: Sequence[int], trees: int) -> DataFrame:
    """Row per fold, seed and part of the trees."""
    return facts.withColumn("semilla", F.explode(F.array(*[F.lit(int(s)) for s in seeds]))).withColumn(
        "_parte", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // TASK_TREES))))


def _part_keys(seed: int, part: int, trees: int) -> np.ndarray:
    return tree_keys(seed, np.arange(part * TASK_TREES, min(trees, (part + 1) * TASK_TREES)))


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _votes_schema(rows: DataFrame, fold: Sequence[str], row: Sequence[str]) -> str:
    return f"{_types(rows, [*fold, *row])}, semilla int, {', '.join(f'_p_{c} long' for c in CLASSES)}"


def _voted(pdf: pd.DataFrame, fold, row, seed: int, chances: np.ndarray) -> pd.DataFrame:
    out = pdf[[*fold, *row]].copy()
    out["semilla"] = seed
    for k, c in enumerate(CLASSES):
        out[f"_p_{c}"] = chances[:, k]
    return out


def _local(rows, facts, fold, row, seeds, trees, depth, bins) -> DataFrame:
    """Votes of folds that fit into a task."""
    schema = _votes_schema(rows, fold, row)
    blocks = _blocks(facts, seeds, trees)
    names = [*fold, "semilla", "_parte"]
    asked = blocks.select(*[F.col(c).alias(f"_b_{i}") for i, c in enumerate(names)], "_pesos", "_bordes")
    wide = rows.join(blocks.select(*names), list(fold))

    def vote(pdf, block):
        if not len(block) or not len(pdf):
            return pd.DataFrame(columns=[*fold, *row, "semilla", *[f"_p_{c}" for c in CLASSES]])
        block = block.iloc[0]
        seed, part, weights = int(block[f"_b_{len(fold)}"]), int(block[f"_b_{len(fold) + 1}"]), np.asarray(block["_pesos"])
        x = _binned(np.stack(pdf["_x"]), block["_bordes"])
        train, test = (pdf["rol"] == TRAIN).to_numpy(), (pdf["rol"] == TEST).to_numpy()
        own = grow(x[train], pdf["_clase"].to_numpy()[train], pdf["_fila"].to_numpy()[train], _part_keys(seed, part, trees), weights, depth, bins)
        return _voted(pdf[test], fold, row, seed, own.chances(x[test], weights))

    return wide.groupBy(*names).cogroup(asked.groupBy(*[f"_b_{i}" for i in range(len(names))])).applyInPandas(vote, schema)


def _loaded(nodes: pd.DataFrame, keys: np.ndarray, depth: int) -> Trees:
    trees = Trees(depth, keys)
    at = nodes["_arbol"].to_numpy(), nodes["_nodo"].to_numpy()
    trees.feature[at], trees.cut[at] = nodes["_variable"], nodes["_corte"]
    trees.counts[at] = nodes[["_n_0", "_n_1", "_n_2"]].to_numpy()
    return trees


def _spread(rows, facts, fold, row, seeds, trees, depth, bins, bucket_rows) -> DataFrame:
    """Votes of folds that are dealt into buckets; one job for each level."""
    schema, names = _votes_schema(rows, fold, row), [*fold, "semilla", "_parte"]
    buckets = F.ceil(F.col("_n") / bucket_rows).cast("int")
    blocks = stored(_blocks(facts, seeds, trees).withColumn("_cubetas", buckets))
    kind = ", ".join([_types(blocks, names)])
    bucket = F.pmod(F.col("_fila"), F.col("_cubetas").cast("long")).cast("int").alias("_cubeta")
    dealt = stored(rows.join(blocks.select(*fold, "_cubetas").distinct(), list(fold)).select(
        *fold, *row, "_fila", "_clase", "_x", "rol", bucket))
    wide = dealt.join(blocks.select(*names), list(fold))
    nodes = rows.sparkSession.createDataFrame([], f"{kind}, {_NODE}")

    def sides(part: str):
        """Rows of a role by block and bucket beside their block with the nodes so far."""
        packed = nodes.groupBy(*names).agg(F.collect_list(F.struct(*[c.split(" ")[0] for c in _NODE.split(", ")])).alias("_nodos"))
        each = blocks.join(packed, names, "left").withColumn("_cubeta", F.explode(F.sequence(F.lit(0), F.col("_cubetas") - 1)))
        keys = [*names, "_cubeta"]
        asked = each.select(*[F.col(c).alias(f"_b_{i}") for i, c in enumerate(keys)], "_pesos", "_bordes", "_nodos")
        return wide.filter(F.col("rol") == part).groupBy(*keys).cogroup(asked.groupBy(*[f"_b_{i}" for i in range(len(keys))]))

    def block_of(block):
        block = block.iloc[0]
        seed, part = int(block[f"_b_{len(fold)}"]), int(block[f"_b_{len(fold) + 1}"])
        found = pd.DataFrame([n.asDict() if hasattr(n, "asDict") else n for n in (block["_nodos"] if block["_nodos"] is not None else [])],
                             columns=[c.split(" ")[0] for c in _NODE.split(", ")])
        own = _loaded(found.astype("int64"), _part_keys(seed, part, trees), depth)
        return own, [block[f"_b_{i}"] for i in range(len(names))], seed, np.asarray(block["_pesos"]), block["_bordes"]

    def counted(level: int):
        def count(pdf, block):
            columns = [*names, *[c.split(" ")[0] for c in _HISTOGRAM.split(", ")]]
            if not len(pdf) or not len(block):
                return pd.DataFrame(columns=columns)
            own, key, _, _, edges = block_of(block)
            x = _binned(np.stack(pdf["_x"]), edges)
            times, at = draws(pdf["_fila"].to_numpy(), own.keys), own.place(x, level)
            t, node, counts, tried = histograms(own, x, pdf["_clase"].to_numpy(), times, at, level, bins)
            n, k, b = np.nonzero(counts.sum(axis=-1))
            out = dict(zip(columns[len(names):], (t[n], node[n], tried[n, k], b, *counts[n, k, b].T)))
            return pd.DataFrame({**{c: [v] * len(n) for c, v in zip(names, key)}, **out}, columns=columns)

        return count

    def decided(last: bool):
        def decide(key, pdf):
            weights = np.asarray(pdf["_pesos"].iloc[0])
            keys = _part_keys(int(key[len(fold)]), int(key[len(fold) + 1]), trees)
            here, own = np.unique(pdf["_arbol"].to_numpy().astype(np.int64) << 32 | pdf["_nodo"].to_numpy(), return_inverse=True)
            tree, node = here >> 32, here & 0xFFFFFFFF
            tried = candidates(keys[tree], node, len(pdf["_bordes"].iloc[0]))
            place = (tried[own] == pdf["_variable"].to_numpy()[:, None]).argmax(axis=1)
            counts = np.zeros((len(here), tried.shape[1], bins, len(CLASSES)), dtype=np.int64)
            counts[own, place, pdf["_casilla"].to_numpy()] = pdf[["_n_0", "_n_1", "_n_2"]].to_numpy()
            own = Trees(depth, keys)
            own.decide(tree, node, counts, tried, weights, last)
            n = own.counts[tree, node]
            return pd.DataFrame({**{c: [v] * len(here) for c, v in zip(names, key)}, "_arbol": tree, "_nodo": node,
                                 "_variable": own.feature[tree, node], "_corte": own.cut[tree, node], "_n_0": n[:, 0], "_n_1": n[:, 1], "_n_2": n[:, 2]})

        return decide

    cell = ["_arbol", "_nodo", "_variable", "_casilla"]
    for level in range(depth + 1):
        parts = sides(TRAIN).applyInPandas(counted(level), f"{kind}, {_HISTOGRAM}")
        whole = parts.groupBy(*names, *cell).agg(*[F.sum(f"_n_{k}").alias(f"_n_{k}") for k in range(len(CLASSES))])
        whole = whole.join(blocks.select(*names, "_pesos", "_bordes"), names)
        found = whole.groupBy(*names).applyInPandas(decided(level == depth), f"{kind}, {_NODE}")
        nodes = stored(nodes.unionByName(found))

    def vote(pdf, block):
        if not len(pdf) or not len(block):
            return pd.DataFrame(columns=[*fold, *row, "semilla", *[f"_p_{c}" for c in CLASSES]])
        own, _, seed, weights, edges = block_of(block)
        return _voted(pdf, fold, row, seed, own.chances(_binned(np.stack(pdf["_x"]), edges), weights))

    return sides(TEST).applyInPandas(vote, schema)

"""Quality by ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed text (character ``GRAM``-grams in ``FEATURES`` slots, square roots of their
shares), and ordered thresholds cut the line of its scores: ``P(grade > k) = sigmoid(w x - t_k)``. That gives an expected
grade and tail probabilities to select by.

It learns from at most ``TRAIN_ROWS`` rated rows, those of smallest hashed id; scoring reads every whole text.

Defined results: null and empty texts have no grams and get the score of the thresholds alone; rows with a null id or
grade are never learned from; an id rated more than once counts with its highest grade; without ratings every grade is
as likely; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weekwatch.session import stored

FEATURES, GRAM, TRAIN_ROWS, ROUNDS, RIDGE = 1024, 4, 6_000, 300, 1e-4
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


def features(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(data) < GRAM:
        return np.zeros(FEATURES, dtype=np.float32)
    n = len(data) - GRAM + 1
    code = sum(data[k : k + n] * _MIX[k] for k in range(GRAM))
    code ^= code >> np.uint32(15)
    counts = np.bincount((code * np.uint32(2246822519) >> np.uint32(22)).astype(np.int64), minlength=FEATURES)
    return np.sqrt(counts / n).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -40, 40)))


def fit(x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """Largest penalised likelihood by Adam on all rows; thresholds stay ordered as a first one and positive steps."""
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    at = np.concatenate((np.zeros(x.shape[1]), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))))
    m, v = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, rounds + 1):
        w, low, gaps = at[: x.shape[1]], at[x.shape[1]], np.exp(at[x.shape[1] + 1 :])
        cuts = low + np.concatenate(([0], np.cumsum(gaps)))
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        margin = x @ w
        below = 1 / (1 + np.exp(-(edge[grade] - margin)))
        above = 1 / (1 + np.exp(-(edge[grade + 1] - margin)))
        p = np.maximum(above - below, 1e-9)
        d_above, d_below = above * (1 - above) / p, below * (1 - below) / p
        g_cut = np.zeros(grades + 1)
        np.add.at(g_cut, grade + 1, -d_above / len(x))
        np.add.at(g_cut, grade, d_below / len(x))
        g_cut = g_cut[1:-1]
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate((x.T @ (d_above - d_below) / len(x) + ridge * w, [tail[0]], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        at = at - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (rounds + 1))
    return Model(at[: x.shape[1]], at[x.shape[1]] + np.concatenate(([0], np.cumsum(np.exp(at[x.shape[1] + 1 :])))))


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_column: str = "doc_id", text: str = "text",
          grade: str = "grade", rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``rows`` rated rows; their features, a fixed number each, reach the driver."""
    one = ratings.filter(F.col(grade).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(
        F.max(grade).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64(id_column), id_column).limit(rows).select(F.col(id_column).alias("_id"), "y")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t).tobytes() for t in pdf["text"]], "y": pdf["y"]})

    sample = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    seen = stored(sample.select("text", "y").mapInPandas(read, "x binary, y int")).toPandas()
    if seen.empty:
        even = np.arange(1, grades) / grades
        return Model(np.zeros(FEATURES), np.log(even / (1 - even)))
    x = np.frombuffer(b"".join(seen["x"]), dtype=np.float32).reshape(-1, FEATURES)
    return fit(x, seen["y"].to_numpy(), grades)


def grade(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``expected_grade`` and ``tails``: P(grade > k) for each grade but the last."""

    @F.pandas_udf("array<double>")
    def tails(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = [model.tails(np.stack([features(t) for t in batch[i : i + 500]])) for i in range(0, len(batch), 500)]
            yield pd.Series([row for part in parts for row in part])

    rated = df.withColumn("tails", tails(F.coalesce(F.col(text), F.lit(""))))
    return rated.withColumn("expected_grade", F.aggregate("tails", F.lit(0.0), lambda a, b: a + b))

"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel counts common character subsequences of length ``ORDER``, each weighted by ``DECAY`` to the power of the
characters it spans, so an insult with inserted or dropped characters stays close to the plain one. A text is a bag of
windows: its space-separated words, and runs of single characters read as one word. Its similarity to a landmark is
that of its nearest window; the landmark similarities, whitened by the landmark kernel (Nyström), are the features of a
linear SVM with squared hinge loss, and a sigmoid fitted to its margins makes the score.

Labels come from at most ``TRAIN_ROWS`` labelled rows, those of smallest hashed id; scoring reads every whole text.

Defined results: null and empty texts have no windows and get the score of a text like nothing toxic; rows with a null
label or id are never learned from; a label repeated for an id counts once, the larger one; without rows of both
labels every score is the share of label 1 (0 for none); repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weekwatch.llm.worker import held, release
from weekwatch.session import stored

ORDER, DECAY = 3, 0.7
#: Bound of the labelled rows learned from; landmarks; longest window (longer words are cut into overlapping ones).
TRAIN_ROWS, LANDMARKS, LONGEST = 20_000, 128, 16
#: Similarities below this, and those to words without so many of a landmark's characters, count as none; words
#: remembered by a Python worker.
FLOOR, MISSING, KNOWN_WORDS = 0.25, 0.4, 100_000
#: Common words among the landmarks; words that landmarks are chosen from; similarity at which a word covers another.
COMMON, CANDIDATES, NEAR, SURE = 8, 1_500, 0.5, 4
#: Character triples looked up at a time.
TRIPLE_CELLS, DIRECT_TRIPLES = 500_000, 1 << 22
COSTS = (0.02, 0.005, 0.1, 0.5, 2.0, 10.0)
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_EDGES = " .,;:!?\"'()[]{}|#*$%&-_/+=<>~^@`"


def windows(text: str) -> set[str]:
    """Words of a text in lower case, and single characters in a row read as one word."""
    lower = text.lower()
    words = set(lower.split())
    words.update(re.sub(r"\s+", "", run) for run in _SPACED.findall(lower))
    return words


def _pieces(word: str) -> list[str]:
    word = word.strip(_EDGES)
    plain = "".join(filter(str.isalnum, word))
    if len(word) <= LONGEST:
        return [word] if plain == word else [word, plain]
    forms = [plain] if len(plain) * 2 > len(word) else [word, plain]
    return [form[i : i + LONGEST] for form in forms
            for i in range(0, max(1, len(form) - LONGEST // 2), LONGEST // 2)]


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(words), width), pad, dtype=np.int32)
    for i, word in enumerate(words):
        out[i, : len(word)] = [ord(c) for c in word]
    return out


def string_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of ``left`` (P, S) with the same row of ``right`` (P, T)."""
    n, width = right.shape
    steps = np.arange(width)
    decay = np.where(steps[None, :] >= steps[:, None], DECAY ** np.maximum(steps[None, :] - steps[:, None], 0), 0)
    decay = (decay * DECAY**2).astype(np.float32)
    partial = [np.ones((n, width), np.float32)] + [np.zeros((n, width), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, np.float32)
    for a in range(left.shape[1]):
        same = (left[:, a, None] == right).astype(np.float32)
        total += DECAY**2 * (same * partial[ORDER - 1]).sum(axis=1)
        for i in range(ORDER - 1, 0, -1):
            ended = (same * partial[i - 1]) @ decay
            partial[i] *= DECAY
            partial[i][:, 1:] += ended[:, :-1]
    return total


def _letters(codes: np.ndarray) -> np.ndarray:
    """A bit for each character of a word, by its code modulo 64."""
    bits = np.left_shift(np.uint64(1), (codes & 63).astype(np.uint64))
    return np.bitwise_or.reduce(np.where(codes >= 0, bits, np.uint64(0)), axis=1)


def similarities(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark, 0 to 1.

    It counts as none if word or landmark lacks more than ``MISSING`` of the other's different characters; that is
    most pairs, so the kernel itself is needed for few.
    """
    out = np.zeros((len(words), len(marks)), dtype=np.float32)
    right = _codes(marks, max(map(len, marks)), -2)
    own = np.array([np.sqrt(string_kernel(c, c))[0] for c in (_codes([w], len(w), -2) for w in marks)])
    marked = _letters(right)
    least = np.ceil(np.bitwise_count(marked) * (1 - MISSING))
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) >= ORDER:
            by_length.setdefault(len(word), []).append(i)
    for length, rows in by_length.items():
        for part in range(0, len(rows), 20_000):
            at = np.array(rows[part : part + 20_000])
            left = _codes([words[i] for i in at], length, -1)
            own_letters = _letters(left)
            shared = np.bitwise_count(own_letters[:, None] & marked[None, :])
            enough = np.ceil(np.bitwise_count(own_letters) * (1 - MISSING))
            u, m = np.nonzero((shared >= least[None, :]) & (shared >= enough[:, None]))
            norm = np.zeros(len(at), np.float32)
            used = np.unique(u)
            norm[used] = np.sqrt(string_kernel(left[used], left[used]))
            for k in range(0, len(u), 20_000):
                a, b = u[k : k + 20_000], m[k : k + 20_000]
                out[at[a], b] = string_kernel(left[a], right[b]) / np.maximum(norm[a] * own[b], 1e-9)
    return out


class Marks:
    """Landmarks by the character triples they hold as gapped subsequences, with the weight of each.

    The kernel of a word and all landmarks is the sum of its own triples' weights times theirs. A word that shares no
    triple, or too few for ``FLOOR`` even if none of its triples met another, is done after a look at a table.
    """

    def __init__(self, marks: list[str]):
        self.marks = marks
        characters = sorted(set("".join(marks)))
        self.base = len(characters) + 1
        self.code = np.zeros(max(map(ord, characters), default=0) + 1, dtype=np.int32 if self.base**3 < 2**31 else np.int64)
        self.code[[ord(c) for c in characters]] = np.arange(1, self.base)
        weights: dict[int, np.ndarray] = {}
        for m, mark in enumerate(marks):
            i, j, k, w = _triples(len(mark))
            c = self.code[[ord(x) for x in mark]] if mark else self.code[:0]
            for triple, weight in zip(((c[i] * self.base + c[j]) * self.base + c[k]).tolist(), w.tolist()):
                weights.setdefault(triple, np.zeros(len(marks), np.float32))[m] += weight
        self.triples = np.array(sorted(weights), dtype=np.int64)
        table = np.array([weights[t] for t in self.triples.tolist()], dtype=np.float64).reshape(-1, len(marks))
        self.norms = np.maximum(np.sqrt((table**2).sum(axis=0)), 1e-9)
        # each triple is in few landmarks: these, one triple after the other
        line, self.mark = np.nonzero(table)
        self.weight = table[line, self.mark]
        self.count = np.append(np.bincount(line, minlength=len(table)), 0)
        self.first = np.cumsum(self.count) - self.count
        self.direct = None
        if self.base**3 <= DIRECT_TRIPLES:
            self.direct = np.full(self.base**3, len(self.triples), dtype=np.int32)
            self.direct[self.triples] = np.arange(len(self.triples))
        self.letters = _letters(_codes(marks, max(map(len, marks), default=1), -2))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that have a similarity of ``FLOOR`` or more, and their similarities, lower ones as 0."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) >= ORDER:
                by_length.setdefault(len(word), []).append(i)
        places, rows = [np.zeros(0, dtype=np.int64)], [np.zeros((0, len(self.marks)), np.float32)]
        for length, own in by_length.items():
            step = max(1, TRIPLE_CELLS // len(_triples(length)[0]))
            for part in range(0, len(own), step):
                at = np.array(own[part:part + step])
                text = "".join(words[i] for i in at).encode("utf-32-le", "surrogatepass")
                found, table = self._near(np.frombuffer(text, dtype=np.uint32).reshape(len(at), length).astype(np.int32))
                places.append(at[found])
                rows.append(table)
        return np.concatenate(places), np.concatenate(rows)

    def _near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j, k, w = _triples(codes.shape[1])
        c = np.where(codes < len(self.code), self.code[np.minimum(codes, len(self.code) - 1)], 0)
        place = self._places((c[:, i] * self.base + c[:, j]) * self.base + c[:, k])
        word, t = np.nonzero(place < len(self.triples))
        line = place[word, t]
        many = self.count[line]
        at = np.repeat(self.first[line] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = np.repeat(word * len(self.marks), many) + self.mark[at]
        raw = np.bincount(cell, weights=np.repeat(w[t], many) * self.weight[at], minlength=len(codes) * len(self.marks))
        raw = raw.reshape(len(codes), len(self.marks))
        least = np.sqrt((w.astype(np.float64) ** 2).sum())  # the norm of a word whose triples all differ
        some = np.flatnonzero((raw >= FLOOR * 0.999 * least * self.norms).any(axis=1))
        raw = raw[some]
        if not len(some):
            return some, raw.astype(np.float32)
        kept = codes[some]
        letters = _letters(kept)
        common = np.bitwise_count(letters[:, None] & self.letters[None, :])
        enough = (common >= np.ceil(np.bitwise_count(self.letters) * (1 - MISSING))[None, :]) & (
            common >= np.ceil(np.bitwise_count(letters) * (1 - MISSING))[:, None])
        table = raw / np.maximum(np.sqrt(string_kernel(kept, kept))[:, None] * self.norms, 1e-9)
        table = np.where(enough & (table >= FLOOR), table, 0).astype(np.float32)
        active = table.any(axis=1)
        return some[active], table[active]


    def _places(self, triples: np.ndarray) -> np.ndarray:
        """Line of each triple in the table; one past the last for those of no landmark."""
        if self.direct is not None:
            return self.direct[triples]
        place = np.searchsorted(self.triples, triples)
        return np.where(np.append(self.triples, -1)[place] == triples, place, len(self.triples))


@lru_cache(maxsize=None)
def _triples(length: int) -> tuple[np.ndarray, ...]:
    """Places of all character triples of a word and the weight of each."""
    i, j, k = (np.array(x, dtype=np.int64) for x in (zip(*combinations(range(length), 3)) if length >= 3 else ((), (), ())))
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


@dataclass
class Model:
    marks: list[str]
    weights: np.ndarray  # of the landmark similarities, whitening included
    bias: float
    slope: float  # of the sigmoid
    shift: float

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift)))


class Featurer:
    """Landmark similarities of texts; remembers the words it has met."""

    def __init__(self, marks: list[str]):
        self.marks, self.place, self.rows = Marks(marks), {}, np.zeros((0, len(marks)), np.float32)

    def learn(self, new: set[str]) -> None:
        if len(self.place) > KNOWN_WORDS:
            self.place, self.rows = {}, self.rows[:0]
        self.place.update(dict.fromkeys(new, -1))
        own = [w for w in new if len(w) <= LONGEST and w.isalnum()]  # a word that is its only piece
        cut = {w: _pieces(w) for w in new.difference(own)}
        words = own + list({p for ps in cut.values() for p in ps}.difference(own))
        found, table = self.marks.near(words)
        at = {words[i]: row for row, i in enumerate(found.tolist(), len(self.rows))}
        self.rows = np.concatenate((self.rows, table))
        self.place.update((w, at[w]) for w in own if w in at)
        joined, end = [], len(self.rows)
        for word, ps in cut.items():
            hit = [at[p] for p in ps if p in at]
            if len(hit) == 1:
                self.place[word] = hit[0]
            elif hit:
                self.place[word] = end + len(joined)
                joined.append(self.rows[hit].max(axis=0))
        if joined:
            self.rows = np.concatenate((self.rows, np.stack(joined)))

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.marks.marks)), np.float32)
        for part in range(0, len(texts), 500):
            bags = [windows(t) for t in texts[part : part + 500]]
            if len(self.place) > KNOWN_WORDS:
                self.place, self.rows = {}, self.rows[:0]
            self.learn(set().union(*bags).difference(self.place))
            for i, bag in enumerate(bags, part):
                at = [p for p in map(self.place.__getitem__, bag) if p >= 0]
                if at:
                    out[i] = self.rows[at].max(axis=0)
        return out


def cover(words: list[str], clean: np.ndarray, bags: list[list[int]], count: int) -> list[int]:
    """Numbers of up to ``count`` words, each the one that covers most label-1 texts not yet near any before it.

    A text is near a word if it holds one at least ``NEAR`` like it; ``clean`` are the shares of label-0 texts with the
    words. What a word covers in label-0 texts counts against it. ``bags`` are the words of each
    label-1 text. A word must cover ``SURE`` standard deviations more than its share of label-0 texts foretells, or it
    would be noise. When nothing is left to cover, the next round begins with all texts again.
    """
    like = similarities(words, words) >= NEAR
    np.fill_diagonal(like, True)
    holds = np.zeros((len(bags), len(words)), dtype=bool)
    for i, bag in enumerate(bags):
        holds[i, bag] = True
    near = np.zeros_like(holds)
    for j in range(len(words)):
        near[:, j] = holds[:, np.flatnonzero(like[j])].any(axis=1)
    against = np.minimum(like @ clean, 1)
    foretold = against * len(bags)
    free = near.sum(axis=0) - foretold >= SURE * np.sqrt(foretold + 1)
    chosen, open_texts = [], np.ones(len(bags), dtype=bool)
    while len(chosen) < count and free.any():
        gain = near[open_texts].sum(axis=0) / max(1, len(bags)) - against
        gain[~free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 0:
            if open_texts.all():
                break
            open_texts[:] = True
            continue
        chosen.append(best)
        free[best] = False
        open_texts &= ~near[:, best]
    return chosen


def landmarks(train: DataFrame, text: str, label: str, count: int = LANDMARKS) -> list[str]:
    """Words that set label 1 apart, chosen so that they cover its texts, then up to ``COMMON`` most common words."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            bags = [{p for w in windows(t or "") for p in _pieces(w) if ORDER <= len(p)} for t in pdf["text"]]
            yield pd.DataFrame({"word": [w for bag in bags for w in bag], "y": [y for y, bag in zip(pdf["y"], bags) for _ in bag],
                                "row": [r for r, bag in zip(pdf["row"], bags) for _ in bag]})

    rows = train.select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"), F.xxhash64("_id", text).alias("row"))
    bags = stored(rows.mapInPandas(words, "word string, y int, row long"))
    sums = stored(bags.groupBy("word").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).filter("n > 2"))
    size = rows.agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).first()
    ratio = size["toxic"] / max(1, size["n"] - size["toxic"])
    excess = F.col("toxic") - (F.col("n") - F.col("toxic")) * ratio
    apart = sums.filter(excess > 0).orderBy((excess * F.col("toxic") / F.col("n")).desc(), "word").limit(CANDIDATES).collect()
    common = sums.filter(F.length("word") > ORDER + 1).orderBy(F.col("n").desc(), "word").limit(count).select("word")
    words_of = [r["word"] for r in apart]
    clean = np.array([r["n"] - r["toxic"] for r in apart], dtype=np.float64)
    number = {w: i for i, w in enumerate(words_of)}
    held = bags.filter("y = 1").join(F.broadcast(sums.sparkSession.createDataFrame([(w,) for w in words_of], "word string")), "word")
    of: dict[int, list[int]] = {}
    for r in held.select("row", "word").toLocalIterator():
        of.setdefault(r["row"], []).append(number[r["word"]])
    first = cover(words_of, clean / max(1, size["n"] - size["toxic"]), list(of.values()), count - COMMON) if words_of else []
    first = [words_of[i] for i in first]
    return first + [r.word for r in common.collect() if r.word not in first][: min(COMMON, count - len(first))]


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; classes weigh the same. Returns weights and bias."""
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum()))) * cost / len(y)
    ones = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    w = np.zeros(ones.shape[1])
    for _ in range(rounds):
        slack = 1 - sign * (ones @ w)
        inside = slack > 0
        if not inside.any():
            break
        a, s = ones[inside], weight[inside]
        new = np.linalg.solve(a.T @ (a * s[:, None]) + ridge, a.T @ (s * sign[inside]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that make the margins probabilities (Platt), by damped Newton steps."""
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def best_cost(x: np.ndarray, y: np.ndarray) -> float:
    """The cost with the smallest log loss on every fifth row, learned from the others."""
    test = np.arange(len(y)) % 5 == 0
    losses = {}
    for cost in COSTS if len(set(y[~test])) == 2 else COSTS[:1]:
        w, bias = fit_svm(x[~test], y[~test], cost)
        slope, shift = fit_sigmoid(x[~test] @ w + bias, y[~test])
        p = 1 / (1 + np.exp(-(slope * (x[test] @ w + bias) + shift)))
        losses[cost] = -np.log(np.clip(np.where(y[test] == 1, p, 1 - p), 1e-9, 1)).mean()
    return min(losses, key=losses.get)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``rows`` labelled rows; what reaches the driver is their landmark similarities."""
    one = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(
        F.max(label).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64(id_column), id_column).limit(rows).select(F.col(id_column).alias("_id"), "y")
    sample = stored(docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text"))
                    .join(F.broadcast(chosen), "_id").select("_id", "text", "y"))
    share = sample.agg(F.avg("y")).first()[0]
    if share in (None, 0.0, 1.0):
        prior = float(share or 0.0)
        return Model(["toxic"], np.zeros(1), 0.0, 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    marks = landmarks(sample, "text", "y") or ["toxic"]
    seen = with_features(sample, marks, "text").select("_id", "_z", "y").toPandas().sort_values("_id")
    z, y = np.array(seen["_z"].tolist(), dtype=np.float64).reshape(-1, len(marks)), seen["y"].to_numpy()
    values, vectors = np.linalg.eigh(similarities(marks, marks).astype(np.float64))
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    x = z @ whiten
    w, bias = fit_svm(x, y, best_cost(x, y))
    return Model(marks, whiten @ w, bias, *fit_sigmoid(x @ w + bias, y))


def _featurer(marks: list[str]) -> Featurer:
    """The worker's featurer for these landmarks; that of another model makes room."""
    return held(("toxicity", *marks), lambda: Featurer(marks))


def with_features(df: DataFrame, marks: list[str], text: str) -> DataFrame:
    @F.pandas_udf("array<float>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(list(_featurer(marks).features(batch.tolist())))

    return df.withColumn("_z", features(F.coalesce(F.col(text), F.lit(""))))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``: the probability of label 1 for each whole text."""

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(_featurer(model.marks).features(batch.tolist()).astype(np.float64)))

    return df.withColumn(out, probability(F.coalesce(F.col(text), F.lit(""))))

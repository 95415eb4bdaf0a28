import itertools
import random

import numpy as np
import pytest

from weekwatch.llm import quality, toxicity


def naive_kernel(s, t):
    """The kernel by listing all subsequences."""
    def weights(word):
        out = {}
        for at in itertools.combinations(range(len(word)), toxicity.ORDER):
            key = "".join(word[i] for i in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out
    a, b = weights(s), weights(t)
    return sum(w * b.get(k, 0) for k, w in a.items())


@pytest.mark.parametrize("s,t", [("idiot", "idiot"), ("idxiot", "idiot"), ("trash", "stash"), ("aaaa", "aaa"), ("abc", "xyz")])
def test_kernel(s, t):
    got = toxicity.string_kernel(toxicity._codes([s], len(s), -1), toxicity._codes([t], len(t) + 2, -2))
    assert got[0] == pytest.approx(naive_kernel(s, t), rel=1e-5)


def test_gaps_stay_near():
    near = toxicity.similarities(["idiot", "idxiot", "idiots", "window"], ["idiot"])[:, 0]
    assert near[0] == pytest.approx(1) and near[1] > 0.5 and near[2] > 0.5 and near[3] < 0.1
    assert "idiot" in toxicity.windows("you i d i o t there") and "idiot" in toxicity._pieces("i.d.i.o.t")


@pytest.mark.parametrize("stars", [1, 2, 3, 9])
def test_letters_of_long_words_are_tried(stars):
    assert "idiot" in toxicity._pieces(("*" * stars).join("idiot"))


def sentences(count, seed):
    rng = random.Random(seed)
    plain = "river stone valley morning letter garden window summer paper light water bridge".split()
    rude = "idiot moron scumbag".split()
    rows = []
    for i in range(count):
        words = [rng.choice(plain) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(12)] = rng.choice(rude)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_and_tolerates(spark, frame):
    rows = sentences(400, 1)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(frame([(i, t) for i, t, _ in rows]), labels)
    fresh = sentences(200, 2)
    more = [(900, None), (901, ""), (902, "you m-o-r-o-n of a river"), (903, "the i d i o t by the stone"), (904, "idxiot light")]
    got = {r.doc_id: r.score for r in toxicity.score(frame([(i, t) for i, t, _ in fresh] + more), model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in fresh]) > 0.97
    assert got[900] == got[901] < 0.5 and min(got[902], got[903], got[904]) > 0.5
    assert toxicity.score(frame([]), model).count() == 0


def test_landmarks_cover_a_small_language(spark, frame):
    rows = sentences(400, 1)
    rng = random.Random(4)
    families = ["".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(30)]
    many = [(1_000 + i, f"river {rng.choice(families)} stone letter", 1) for i in range(1_200)]
    small = [(3_000 + i, "nopqrs montaña valle " + ("zurruxo" if i % 2 else "quieto") + " camino", i % 2) for i in range(40)]
    docs = rows + many + small
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    model = toxicity.train(frame([(i, t) for i, t, _ in docs]), labels)
    assert "zurruxo" in model.marks
    got = {r.doc_id: r.score for r in toxicity.score(frame([(1, "valle zurruxo de montaña"), (2, "valle quieto de montaña")]), model).collect()}
    assert got[1] > 0.5 > got[2]


def test_toxicity_without_both_labels(spark, frame):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame([(1, "a b c")]), labels)
    assert [r.score < 0.01 for r in toxicity.score(frame([(1, "a b c"), (None, None)]), model).collect()] == [True, True]


def test_ordinal_regression(spark, frame):
    rng = random.Random(3)
    words = {0: "%%% ### &&& $$$", 1: "stone ### river &&&", 2: "stone river garden light"}
    rows = [(i, " ".join(rng.choice(words[i % 3].split()) for _ in range(40)), i % 3) for i in range(300)]
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 2)], "doc_id long, grade int")
    model = quality.train(frame([(i, t) for i, t, _ in rows]), ratings, 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.grade(frame([(i, t) for i, t, _ in rows] + [(None, None)]), model).collect()
    right = [round(r.expected_grade) == r.doc_id % 3 for r in got if r.doc_id is not None]
    assert np.mean(right) > 0.95 and all(r.tails[0] >= r.tails[1] for r in got)
    none = quality.train(frame([(1, "x")]), ratings.limit(0), 3)
    assert [round(r.expected_grade, 6) for r in quality.grade(frame([(1, "x")]), none).collect()] == [1.0]
    assert quality.grade(frame([]), model).count() == 0


def test_triple_tables_give_the_kernel():
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeidot") for _ in range(rng.randrange(1, 17))) for _ in range(3000)] + ["idi🙂ot", "", "ab", "ÑÑÑ", "idiot" * 3]
    marks = ["idiot", "toad", "bicoded", "aaa", "décode"]
    plain = toxicity.similarities(words, marks)
    plain[plain < toxicity.FLOOR] = 0
    at, table = toxicity.Marks(marks).near(words)
    found = np.zeros_like(plain)
    found[at] = table
    assert np.abs(found - plain).max() < 1e-5 and len(at) == plain.any(axis=1).sum() > 100
    many = [chr(200 + i) * 3 + chr(201 + i) for i in range(300)]  # too many characters for a direct table
    assert toxicity.Marks(many).direct is None
    at, table = toxicity.Marks(many).near(many)
    assert list(at) == list(range(300)) and np.allclose(np.diag(table), 1)


def test_featurer_is_the_nearest_piece_of_each_landmark():
    marks = ["idiot", "stupid", "window"]
    own = toxicity.Featurer(marks)
    texts = ["an i.d.i.o.t here", "s t u p i d!", "nothing at all", "", "idiotidiotidiotidiot and windows", "an i.d.i.o.t here"]
    got = own.features(texts)
    for row, text in zip(got, texts):
        pieces = [p for w in toxicity.windows(text) for p in toxicity._pieces(w)]
        table = toxicity.similarities(pieces, marks) if pieces else np.zeros((1, 3))
        table[table < toxicity.FLOOR] = 0
        assert np.abs(row - table.max(axis=0)).max() < 1e-5


def test_a_worker_keeps_only_the_latest_object():
    from weekwatch.llm import worker

    first = worker.held("a", list)
    assert worker.held("a", list) is first
    worker.held("b", list)
    assert worker.held("a", list) is not first

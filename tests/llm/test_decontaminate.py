import random

import pytest

from weekwatch.llm import decontaminate


def brute(docs, items, size):
    out = []
    for _, text in docs:
        words = decontaminate.words(text)
        hit, found = set(), set()
        for item, body in items:
            own = decontaminate.words(body)
            n = min(size, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own and item is not None else set()
            for i in range(len(words) - n + 1 if windows else 0):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out.append((len(words), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_equals_brute_force(spark, frame, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(4)
    body = lambda n: " ".join(rng.choice("a b c d E é 12".split()) for _ in range(n))
    items = [(i, body(rng.randrange(14))) for i in range(12)] + [(3, "a-b,C"), (None, "d d"), (99, None), (98, "zz zz")]
    docs = [(i, body(rng.randrange(60))) for i in range(30)] + [(1, None), (2, ""), (2, ""), (None, "a b. c\nd")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(frame(docs), bench, size=5, slop=1).collect()
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in got) == brute(docs, items, 5)
    assert all(set(r["items"]) <= set(r.near_items) for r in got)


def test_near_match_is_not_exact(spark, frame):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = frame([(1, "x alpha of beta gamma y"), (2, "alpha x x x x x x x x gamma beta"), (3, "Alpha, beta gamma")])
    got = {r.doc_id: (list(r["items"]), list(r.near_items)) for r in decontaminate.matches(docs, bench, 3, 2).collect()}
    assert got == {1: ([], ["1"]), 2: ([], []), 3: (["1"], ["1"])}


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.matches(frame([(1, "a b")]), bench).collect()] == [(2, 0)]
    assert decontaminate.matches(frame([]), bench).count() == 0

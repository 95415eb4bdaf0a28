"""Grammar-compressed runs against a plain quadratic search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from weekwatch.llm import queries, word_runs


def plain(words, shortest=6, power=4):
    """Every maximal run, by trying each period."""
    n, seen = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, power * q):
                seen.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in seen.items())


def own(words, **kw):
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    a, z, q = word_runs.runs_of(x, np.zeros(len(x), dtype=np.int64), **kw) if len(x) else ((), (), ())
    return [(int(s), int(e - s), int(p)) for s, e, p in zip(a, z, q)]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=120))
def test_few_words(words):
    assert own(words) == plain(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=9), st.integers(1, 9)), max_size=12))
def test_repeated_blocks(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert own(words) == plain(words)


def cases():
    rng = random.Random(3)
    yield ["x"] * 2049
    yield [str(i % 700) for i in range(3500)]
    yield [str(i % 64) for i in range(400)] + [str(rng.randrange(50)) for _ in range(900)] + [str(i % 97) for i in range(500)]
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 900:
        fib = fib[1], fib[1] + fib[0]
    yield fib[1] * 5
    block = (["a"] * 7 + ["b"]) * 6
    yield (block + ["c"]) * 9 + ["d"] + block * 4
    yield [rng.choice("ab") for _ in range(1500)]
    yield [str(i) for i in range(800)]


@pytest.mark.parametrize("words", list(cases()), ids=lambda w: str(len(w)))
def test_cases(words):
    assert own(words) == plain(words)
    assert own(words, shortest=12, power=5) == plain(words, 12, 5)


def test_documents_laid_end_to_end_do_not_touch():
    docs = [w for w in cases()] + [[], ["a"], ["a"] * 6, ["a"] * 5]
    random.Random(1).shuffle(docs)
    got = list(word_runs.collapse([[w.encode() for w in d] for d in docs]))
    for d, (n, found, text) in zip(docs, got):
        runs = plain(d)
        assert n == len(d) and [tuple(r.values()) for r in found] == runs
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert text == " ".join(w for i, w in enumerate(d) if i not in gone)


def test_frame_with_odd_rows(spark, monkeypatch):
    texts = [None, "", " \t\n", "a b " * 4, "a b " * 4, "x y  z\x1c" * 6, "na " * 6 + "batman", "q " * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "*", "1 AS row", "2 AS made", "3 AS runs", "4 AS starts", "5 AS `a.b`")
    done = word_runs.collapse_runs(df)
    assert done.columns == ["doc_id", "text", "row", "made", "starts", "a.b", "n_words", "runs", "collapsed"]
    got = {r["doc_id"]: r for r in done.collect()}
    for i, t in enumerate(texts):
        words = [w.decode() for w in word_runs.split_words(t or "")]
        assert [tuple(r) for r in got[i]["runs"]] == plain(words) and got[i]["made"] == 2
    assert got[6]["collapsed"] == "na batman" and got[0]["collapsed"] == "" and got[0]["n_words"] == 0
    assert word_runs.collapse_runs(df.filter("false")).count() == 0


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(r[1]) < 9000]
    chosen = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 10 == 0] + rows[:40] + [(None, "a " * 9), (-5, None), (7, ""), (7, "")]
    spark.createDataFrame(chosen, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_grammar_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in chosen), key=str)
    assert got.filter("n_runs > 0").count() > 5

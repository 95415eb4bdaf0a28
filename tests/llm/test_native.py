import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from weekwatch.llm import licences, ngram_lm, queries, sketches


def by_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(sql).fetchall(), key=str)


def test_licences(frame):
    mit = licences.TEMPLATES[-2][1]
    rows = [(1, "Prose.\nreleased UNDER the *MIT* license\nmore"), (2, mit[:150] + "\n" + mit[150:]), (3, None), (4, ""), (5, "one"),
            (6, "Released under the MIT License.\n\nLicensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0."),
            (7, "word " * 5_000), (None, "Released under the MIT License.")]
    got = licences.scan(frame(rows)).select("doc_id", "licence", "dice", "n_passages")
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(rows, licences.oracle())
    assert {(r.doc_id, r.licence) for r in got.collect()} == {
        (1, "MIT"), (2, "MIT"), (6, "MIT"), (6, "CC-BY-NC-4.0"), (None, "MIT")}
    assert licences.scan(frame([])).count() == 0


def sketch_rows():
    rng = random.Random(9)
    body = lambda n: " ".join("w%d." % rng.randrange(400) for _ in range(n))
    shared = body(300)
    return [(5_000_000 * i, t) for i, t in enumerate(
        ["", body(1), body(3), shared, shared, shared + " " + body(40), body(900), None, "é\nß\n漢 字", body(60)])]


def test_sketches_equal_sets(frame):
    rows = sketch_rows()
    got = sketches.fingerprint_edits(frame(rows))
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(rows, sketches.oracle())
    near = {r.doc_id: r.near_next for r in got.collect()}
    assert near[15_000_000] == 1.0 and 0.5 < near[20_000_000] < 1.0


def test_small_sketch_fails_and_larger_succeeds(spark):
    df = spark.createDataFrame([(list(range(1, 40)), list(range(20, 60)))], "a array<long>, b array<long>")
    df = df.select(*[F.transform(c, lambda d: F.pmod(F.xxhash64(d), F.lit(1 << 60))).alias(c) for c in "ab"])
    small = F.expr(sketches.peel(sketches.subtract(sketches.cells("a", 4), sketches.cells("b", 4)), 4))
    large = F.expr(sketches.peel(sketches.subtract(sketches.cells("a", 64), sketches.cells("b", 64)), 64))
    row = df.select(small.alias("small"), large.alias("large"), F.expr(sketches.difference("a", "b")).alias("d")).first()
    assert row.small is None and row.large in (None, 39) and row.d == 39


@pytest.mark.parametrize("span", [12, 1])
def test_next_text(frame, monkeypatch, span):
    monkeypatch.setattr(sketches, "_SPAN", span)
    rows = [(7, "b"), (7, "a"), (-3, "neg"), (None, "none"), (10**12, "far"), (8, None)]
    got = {(r.doc_id, r.text): r.next_text for r in sketches.with_next(frame(rows)).collect()}
    assert got == {(None, "none"): "neg", (-3, "neg"): "a", (7, "a"): "b", (7, "b"): "", (8, ""): "far", (10**12, "far"): "none"}
    assert [r.next_text for r in sketches.with_next(frame([(1, "own")])).collect()] == ["own"]
    assert sketches.fingerprint_edits(frame([])).count() == 0


def brute_scores(rows, size, least):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([w.decode() for w in ngram_lm.words(t)])
    unigrams = Counter(w for ws in texts.values() for x in ws for w in x)
    top = {w for w, _ in sorted(unigrams.items(), key=lambda x: (-x[1], x[0]))[:size]}
    name = lambda w: w if w in top else "<other>"
    total = sum(unigrams.values())
    ones, twos = Counter(), Counter()
    for ws in texts.values():
        for x in ws:
            ones.update(map(name, x))
            twos.update(zip(map(name, x), map(name, x[1:])))
    out = {}
    for i, ws in texts.items():
        s = 0.0
        for x in ws:
            x = list(map(name, x))
            s += sum(math.log(ones[w] / total) for w in x[:1])
            for a, b in zip(x, x[1:]):
                s += math.log(twos[a, b] / ones[a] if twos[a, b] >= least else ngram_lm.BACKOFF * ones[b] / total)
        out[i] = (sum(map(len, ws)), round(s, 6))
    return out


@pytest.mark.parametrize("heavy", [20_000, 5])
def test_scores(frame, monkeypatch, heavy):
    monkeypatch.setattr(ngram_lm, "HEAVY", heavy)
    rng = random.Random(heavy)
    rows = [(i, " ".join(rng.choice("a a a b c d e f g h".split()) for _ in range(rng.randrange(30)))) for i in range(30)]
    rows += [(1, "a b c"), (2, None), (50, ""), (None, "a b zz"), (51, "once")]
    got = {r.doc_id: (r.n_words, round(r.log_score, 6)) for r in ngram_lm.score(frame(rows), size=6).collect()}
    assert _close(got, brute_scores(rows, 6, 2))
    assert ngram_lm.score(frame([])).count() == 0


def _close(a, b):
    return a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-5 for k in a)


@pytest.mark.parametrize("size, heavy", [(6, 5), (6, 20_000), (1, 5), (0, 5)])
def test_scores_of_every_word(frame, monkeypatch, size, heavy):
    """With ``apart`` the vocabulary bounds a broadcast only: words beyond it keep their own counts."""
    monkeypatch.setattr(ngram_lm, "HEAVY", heavy)
    rng = random.Random(heavy + size)
    rows = [(i, " ".join(rng.choice("a a a b c d e f g h ä".split()) for _ in range(rng.randrange(30)))) for i in range(30)]
    rows += [(1, "a b c"), (2, None), (50, ""), (None, "a b zz"), (51, "once"), (52, "once zz zz zz ä ä")]
    got = {r.doc_id: (r.n_words, round(r.log_score, 6)) for r in ngram_lm.score(frame(rows), size=size, apart=True).collect()}
    assert _close(got, brute_scores(rows, 10**9, 2))
    assert ngram_lm.score(frame([]), apart=True).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11))

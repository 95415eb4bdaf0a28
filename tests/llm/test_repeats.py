import random

import numpy as np
import pytest

from weekwatch.llm import repeats, suffix_array


@pytest.mark.parametrize("buckets", [2, 4096])
def test_suffix_array_equals_sorting(monkeypatch, buckets):
    monkeypatch.setattr(suffix_array, "BUCKETS", buckets)
    rng = random.Random(buckets)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 20])
        text = [rng.randint(1, k) for _ in range(rng.randint(1, 60))] + [0]
        got = suffix_array.suffix_array(np.array(text, dtype=np.int16), k + 1)
        assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, width):
    """Kept bytes and runs by the definition; rows are (order key, bytes), repeated keys counting once."""
    first = {}
    for key, octets in sorted(set(rows)):
        for i in range(len(octets) - width + 1):
            first.setdefault(octets[i : i + width], (key, i))
    out = {}
    for key, octets in set(rows):
        gone = np.zeros(len(octets), dtype=bool)
        for i in range(len(octets) - width + 1):
            if first[octets[i : i + width]] < (key, i):
                gone[i : i + width] = True
        out[key] = bytes(b for b, g in zip(octets, gone) if not g)
    return out


@pytest.mark.parametrize("many", [4_000, 1])
def test_equals_definition(frame, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 300)
    rng = random.Random(many)
    passage = "".join(rng.choice("abcdé ") for _ in range(70))
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(120))) for _ in range(40)]
    texts = [t[:i] + passage[rng.randrange(30) :] + t[i:] if rng.random() < 0.6 else t for i, t in enumerate(texts)]
    texts += ["a" * 150, "ab" * 80, "", texts[3], texts[3]]
    got = repeats.remove_repeats(frame(list(enumerate(texts))), width=40).collect()
    want = brute([(i, t.encode()) for i, t in enumerate(texts)], 40)
    assert {r.doc_id: bytes(r.kept) for r in got} == want
    for r in got:
        octets = texts[r.doc_id].encode()
        assert r.n_bytes == len(octets) and r.lang == "x"
        assert sum(s.stop - s.start for s in r.spans) == len(octets) - len(r.kept)


def test_nulls_and_repeated_ids(frame):
    long = "0123456789" * 2 + "abcdefghij" * 2
    rows = [(1, long), (1, long), (2, None), (None, "x" + long), (2, "y" + long)]
    got = {(r.doc_id, r.n_bytes): len(r.kept) for r in repeats.remove_repeats(frame(rows), width=30).collect()}
    assert got == {(1, 40): 0, (2, 0): 0, (None, 41): 41, (2, 41): 1}
    assert repeats.remove_repeats(frame([]), width=30).count() == 0


def test_thousands_of_rows_of_one_id_are_told_apart(spark):
    """Every text of a shared id loses exactly what an earlier one (by hash of the text) has."""
    import hashlib

    from pyspark.sql import functions as F

    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [own(rng.randrange(5, 60)) for _ in range(2990)] + [own(20) + passage + own(20) for _ in range(10)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = {bytes(r["kept"]): len(r["spans"]) for r in repeats.remove_repeats(df.withColumn("no", F.monotonically_increasing_id())).collect()}
    holders = sorted((t for t in texts if passage in t), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    untouched = [t for t in texts if passage not in t] + holders[:1]
    assert all(got.get(t.encode()) == 0 for t in untouched)
    assert sum(n for n in got.values()) == 9


def test_columns_of_any_name_stay(spark):
    from pyspark.sql import functions as F

    names = ["_doc", "_copy", "_text", "_row", "_packed", "_rows", "_r", "_hash", "_deal", "doc", "copy", "at", "n", "a.b"]
    df = spark.createDataFrame([(1, "x" * 250), (1, "y" * 250), (2, "x" * 250)], "doc_id long, text string").select(
        "*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    done = repeats.remove_repeats(df)
    assert done.columns == ["doc_id", *names, "n_bytes", "spans", "kept"]
    for r in done.collect():
        assert [r[n] for n in names] == list(range(len(names))) and len(r["kept"]) in (1, 0)


def test_a_shard_is_bounded_by_its_bytes(frame, monkeypatch):
    """Few but long stretches of one anchor fill no shard; the result is that of the definition."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2_000)
    sort = repeats.repeated_windows

    def checked(pieces, keys, width):
        assert sum(map(len, pieces)) <= 2_000
        return sort(pieces, keys, width)

    monkeypatch.setattr(repeats, "repeated_windows", checked)
    texts = ["a" * n for n in (900, 700, 800, 50, 39)] + ["b" * 300 + "c", "d" + "b" * 200, "ab" * 600]
    got = repeats.remove_repeats(frame(list(enumerate(texts))), width=40).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == brute([(i, t.encode()) for i, t in enumerate(texts)], 40)


def test_memory_of_a_shard():
    """Sorting takes less than 70 bytes for each byte of a shard."""
    import tracemalloc

    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 10), dtype=np.uint8)) for _ in range(2_000)]
    pieces = [b" ".join(words[k] for k in rng.integers(0, 2_000, 30)) for _ in range(3_000)]
    tracemalloc.start()
    suffix_array.repeated_windows(pieces, [(i, 0) for i in range(len(pieces))], 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * sum(map(len, pieces)), peak / sum(map(len, pieces))


def test_halves_of_a_stretch_are_few():
    """A stretch makes two parts, not a row for each window; a run of one letter makes one and names the rest."""
    rng = np.random.default_rng(11)
    octets = bytes(rng.integers(0, 256, 167, dtype=np.uint8))
    anchor, start, count, _ = repeats.anchors(octets, 100)
    for m, a, n in zip(anchor.tolist(), start.tolist(), count.tolist()):
        parts, known = repeats.halves(octets[a : a + n + 99], m, 0, 69, 100)
        assert len(parts) <= 2 and not known and sum(p[-1] for p in parts) == n
    run = b"a" * 5_000
    parts, known = repeats.halves(run, int(repeats.anchors(run, 100)[0][0]), 0, 69, 100)
    assert [p[-2:] for p in parts] == [(0, 1)] and known == [[1, 4_900]]


def test_rims_of_a_common_passage_make_few_rows(frame, monkeypatch):
    """Documents that share a passage make a few rows each, not one for each window over its rims."""
    monkeypatch.setattr(repeats, "MANY", 50)
    made, store = [], repeats.stored

    def counted(df):
        out = store(df)
        made.extend([out.count()] if "piece" in out.columns else [])
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage = word(400)
    texts = [word(150) + passage + word(150) for _ in range(300)]
    got = repeats.remove_repeats(frame(list(enumerate(texts)))).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == brute([(i, t.encode()) for i, t in enumerate(texts)], 100)
    assert made and max(made) <= 8 * len(texts), made

import random

import numpy as np
import pytest
import xxhash

from weekwatch.llm import components, simhash


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, bits):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_values(count, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)]
    return list(dict.fromkeys(
        centres[rng.randrange(8)] ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(4))})
        for _ in range(count)))


@pytest.mark.parametrize("text", ["", None, "One", "One two", "A b c d E É ß", "x " * 700, " ".join(map(str, range(900)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute(text)
    assert simhash.fingerprint(text, at_once=7) == brute(text)


def test_link_group_equals_all_pairs():
    values = near_values(200, 1)
    keys = np.zeros(len(values), dtype=np.int64)
    got = simhash.link_group(keys, np.array(values, dtype=np.uint64), 2)
    want = classes(values, 2)
    assert len(set(zip(got.tolist(), want))) == len(set(got.tolist())) == len(set(want))


@pytest.mark.parametrize("limit", [3_000, 2])
def test_links_lose_no_pair(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", limit)
    monkeypatch.setattr(simhash, "GROUP_ROWS", 50)
    values = near_values(150, 2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = {r.node: r.root for r in components.components(simhash.links(nodes)).collect()}
    got, want = [root.get(v, v) for v in signed], classes(values, 2)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_rows_nulls_ties_and_copies(frame):
    rows = [(5, "a b c d"), (3, "A  B c\td"), (3, "A  B c\td"), (9, None), (8, ""), (None, "a b c d"), (None, "alone here now")]
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(frame(rows)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (0, 3), (0, None)], key=str)
    assert simhash.near_duplicates(frame([]).limit(0)).count() == 0

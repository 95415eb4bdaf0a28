"""Certified multi-index search against all products."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weekwatch.llm import multi_index, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, positives=5, negatives=5):
    """Rows are (id, label, vector) that take part, each once."""
    q = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    out = []
    for a, la, _ in rows:
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q[a], q[i])) for i, _, _ in rows if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        label = {i: lab for i, lab, _ in rows}
        for p in [i for i in order if label[i] == la][:positives]:
            fit = [i for i in order if label[i] != la and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:negatives]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, dim, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(clusters, size=n)] + 0.3 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[n // 2: n // 2 + n // 3] = x[0]  # a third of the rows share one vector: ties
    return [(i, int(rng.integers(4)), [float(f) for f in np.float32(v)]) for i, v in enumerate(x)]


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("n, dim, words, shard_rows, block", [(420, 7, 4, 50, 3), (300, 16, None, None, 4096), (90, 1, 3, 20, 2)])
def test_equals_all_products(spark, n, dim, words, shard_rows, block):
    rows = vectors(n, dim, n)
    df = spark.createDataFrame(rows, SCHEMA)
    got = multi_index.hard_negatives(df, F.col("vec_id") % 20 == 0, words=words, shard_rows=shard_rows, block_queries=block)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute(rows, lambda i: i % 20 == 0)


def test_rows_that_take_no_part_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.8, 0.5]), (3, 1, [-1.0, 0.0]), (4, 2, [0.0, 0.0]), (5, 3, [0.8, 0.5])]
    odd = [(6, None, [1.0, 1.0]), (7, 1, None), (8, 1, [1.0, None]), (9, 2, [nan, 1.0]), (10, 2, [inf, 1.0]), (None, 2, [0.8, 0.5]), (11, 2, [1e30, 0.0])]
    df = spark.createDataFrame(rows + rows[:3] + odd, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS rid", "4 AS anchor", "5 AS qid", "6 AS `a.b`")
    got = multi_index.hard_negatives(df, F.col("vec_id") == 0)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i == 0)
    for few in (df.filter("false"), df.filter("label IS NULL"), df.filter("vec_id = 0")):
        assert multi_index.hard_negatives(few, F.col("vec_id") == 0).count() == 0
    assert multi_index.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_short_vectors_count_as_filled_with_zeros(spark):
    rows = [(0, 1, [1.0, 0.5, 0.1]), (1, 1, [0.9]), (2, 2, [0.8, 0.1]), (3, 2, [])]
    got = multi_index.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == brute([(i, b, v + [0.0] * (3 - len(v))) for i, b, v in rows], lambda i: i == 0)


def test_multi_sequence_gives_all_pairs_by_falling_sum():
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=9), rng.normal(size=5)
    walked = list(multi_index.multi_sequence(u, v))
    assert len({(a, b) for _, a, b in walked}) == 45 and [w[0] for w in walked] == sorted((x + y for x in u for y in v), reverse=True)


def test_stops_early_on_clustered_rows():
    import pandas as pd

    rng = np.random.default_rng(2)
    centres = 100 * rng.normal(size=(40, 8))
    x = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 8)))
    books = multi_index.Codebooks(x, 16)
    (i, r1), (j, r2) = books.nearest(x)
    np.maximum.at(books.radii[0], i, r1)
    np.maximum.at(books.radii[1], j, r2)
    shard = multi_index.Shard(pd.DataFrame({"i": i, "j": j, "id": range(4000), "label": 0, "v": list(x)}), books)
    visited = [shard.search(x[k], k, 0, True, [(-(2**62), 2**62)], 5)[1] for k in range(0, 4000, 400)]
    assert max(visited) < len(shard.cells)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    rel = con.sql(queries.ORACLES["op12_multi_index_negatives"])
    assert rel.columns == COLUMNS
    got = queries.QUERIES["op12_multi_index_negatives"](spark, folder)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(rel.fetchall()) != []

"""Forests of all folds at once: same trees on both ways, leak-free folds, odd folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekwatch.functions.classify import CLASSES
from weekwatch.operators import folds, forests

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4)).round(3)
    score = x[:, 0] + 0.5 * np.abs(x[:, 1]) + 0.1 * rng.normal(size=600)
    label = [CLASSES[int(s > 0) + int(s > 0.9)] for s in score]
    data = [(i % 3, 1999 + i % 4, i, lab, *map(float, v)) for i, (lab, v) in enumerate(zip(label, x))]
    return spark.createDataFrame(data, "region int, anio int, semana int, etiqueta string, a double, b double, c double, d double")


def predicted(assigned, fold, **kw):
    return forests.fold_predictions(assigned, NAMES, fold, ["region", "anio", "semana"], seeds=(0, 7), trees=30, depth=6, **kw)


def test_tasks_and_buckets_grow_the_same_trees(rows):
    parts = folds.forward_chaining(rows, [2001, 2002], [1999, 2000, 2001, 2002])
    whole = {tuple(r)[:6]: tuple(r)[6:] for r in predicted(parts, ["anio_externo"]).collect()}
    dealt = {tuple(r)[:6]: tuple(r)[6:] for r in predicted(parts, ["anio_externo"], local_rows=350, bucket_rows=64).collect()}
    assert whole == dealt and len(whole) == 2 * 300  # one fold of 300 training rows, one of 450
    again = {tuple(r)[:6]: tuple(r)[6:] for r in predicted(parts.repartition(7), ["anio_externo"]).collect()}
    assert whole == again


def test_predictions_are_probabilities_and_good(rows):
    parts = folds.key_out_forward(rows, "region", [2002], [1999, 2000, 2001])
    done = predicted(parts, ["clave_externa", "anio_externo"])
    assert done.filter("abs(p_bajo + p_medio + p_alto - 1) > 1e-6 OR clave_externa <> region OR anio <> 2002").count() == 0
    assert done.agg(F.avg((F.col("pred") == F.col("etiqueta")).cast("int"))).scalar() is not None
    share = done.agg(F.avg((F.col("pred") == F.col("etiqueta")).cast("int")).alias("s")).first()["s"]
    assert done.count() == 300 and share > 0.8


def test_key_out_rows(rows):
    small = rows.filter("semana < 40")
    parts = folds.key_out_forward(small, "region", [2001], [1999, 2001], [2000])
    got = {(r["clave_externa"], r["semana"], r["rol"]) for r in parts.collect()}
    base = small.collect()
    expected = {(r["region"], r["semana"], "prueba") for r in base if r["anio"] == 2001}
    expected |= {(k, r["semana"], "entrenamiento") for r in base if r["anio"] == 1999 for k in range(3) if k != r["region"]}
    assert got == expected


def test_fold_of_one_class_is_not_trained(rows):
    low = rows.withColumn("etiqueta", F.when(F.col("anio") < 2001, "bajo").otherwise(F.col("etiqueta")))
    done = predicted(folds.forward_chaining(low, [2001, 2002], [1999, 2000, 2001]), ["anio_externo"])
    untrained = done.filter("anio_externo = 2001")
    assert untrained.count() == 150 and untrained.filter("semilla IS NOT NULL OR pred IS NOT NULL OR p_alto IS NOT NULL").count() == 0
    assert done.filter("anio_externo = 2002 AND semilla IS NULL").count() == 0 and done.count() == 150 + 300


def test_absent_class_gets_probability_zero(rows):
    two = rows.filter("anio = 2002 OR etiqueta <> 'medio'")
    done = predicted(folds.forward_chaining(two, [2002], [1999, 2000, 2001]), ["anio_externo"])
    assert done.filter("p_medio <> 0").count() == 0 and done.filter("p_alto > 0.5").count() > 10


def test_empty(rows):
    parts = folds.forward_chaining(rows.filter("false"), [2002], [1999])
    assert predicted(parts, ["anio_externo"]).count() == 0


def test_best_cut_against_all_cuts():
    rng = np.random.default_rng(9)
    weights = np.array([0.5, 1.5, 2.0])
    counts = rng.integers(0, 5, size=(40, 2, 6, 3))
    counts[:, 1] = 0
    counts[:, 1, 3] = counts[:, 0].sum(axis=1)  # the second candidate has one bin, so no cut
    counts[0, 0, 1:] = 0
    counts[0, 1] = 0
    counts[0, 1, 3] = counts[0, 0, 0]
    best, cut = forests.best_cuts(counts, weights)
    for node, k, at in zip(counts * weights, best, cut):
        def purity(side):
            return (side**2).sum() / side.sum() if side.sum() else 0.0

        gains = [purity(node[0, :c + 1].sum(0)) + purity(node[0, c + 1:].sum(0)) - purity(node[0].sum(0)) for c in range(5)
                 if node[0, :c + 1].sum() and node[0, c + 1:].sum()]
        if not gains or max(gains) < 1e-9:
            assert at == -1
        else:
            own = purity(node[0, :at + 1].sum(0)) + purity(node[0, at + 1:].sum(0)) - purity(node[0].sum(0))
            assert k == 0 and own == pytest.approx(max(gains))


def test_draws_have_mean_one_and_differ_by_tree():
    times = forests.draws(np.arange(4000), forests.tree_keys(3, np.arange(20)))
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert len({tuple(t) for t in times}) == 20

import random

from pyspark.sql import functions as F

from weekwatch.operators import features, folds, forests, metrics, models, ranking


def labelled(spark, rows):
    return spark.createDataFrame(rows, "pais string, anio int, semana int, etiqueta string")


def sample(n=400, seed=3):
    rng = random.Random(seed)
    return [(rng.choice("abcd"), rng.choice([2018, 2019, 2020, 2021]), w, rng.choice(["bajo", "bajo", "medio", "alto"])) for w in range(n)]


def test_running_totals_equal_a_sorted_scan_with_one_dominant_value(spark):
    rng = random.Random(1)
    values = [0.5] * 700 + [rng.random() for _ in range(1300)]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, n int")
    for descending in (False, True):
        got = {r.v: (r.n, r.n_antes, r.n_grupo) for r in ranking.running_totals(df, "v", ["n"], range_values=90, descending=descending).collect()}
        seen = 0
        for v in sorted(set(values), reverse=descending):
            assert got[v] == (values.count(v), seen, len(values))
            seen += values.count(v)
    assert ranking.exact_median(df, "v").first().mediana == sorted(values)[999] / 2 + sorted(values)[1000] / 2


def test_auc_and_average_precision_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice(["alto", "bajo"]), rng.randint(0, 9) / 10) for g in "xy" for _ in range(150)] + [("z", "bajo", 0.3)]
    df = spark.createDataFrame(rows, "g string, real string, p double")
    auc = {r.g: r.auc for r in metrics.roc_auc(df, ["g"], "p").collect()}
    points = metrics.precision_recall_points(df, ["g"], "p")
    ap = {r.g: r.precision_media for r in metrics.average_precision(points, ["g"]).collect()}
    assert auc["z"] is None and "z" not in ap
    for g in "xy":
        pos = [p for k, r, p in rows if k == g and r == "alto"]
        neg = [p for k, r, p in rows if k == g and r != "alto"]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert abs(auc[g] - wins / (len(pos) * len(neg))) < 1e-12
        expected, last = 0.0, 0.0
        for t in sorted({*pos, *neg}, reverse=True):
            tp, fp = sum(a >= t for a in pos), sum(b >= t for b in neg)
            expected += (tp / len(pos) - last) * tp / (tp + fp)
            last = tp / len(pos)
        assert abs(ap[g] - expected) < 1e-12
    curve = metrics.precision_recall_curve(points, ["g"]).filter("g = 'x' AND umbral IS NULL").first()
    assert (curve.precision, curve.recall) == (1.0, 0.0)


def test_class_metrics_over_a_fixed_class_list(spark):
    rows = [("bajo", "bajo"), ("bajo", "alto"), ("alto", "alto"), ("alto", None)]
    got = metrics.class_metrics(spark.createDataFrame(rows, "real string, pred string"), []).first()
    assert (got.precision_alto, got.recall_alto, got.soporte_alto, got.filas_excluidas) == (0.5, 1.0, 1, 1)
    assert (got.f1_medio, got.falsos_positivos_alto) == (0.0, 1)
    assert abs(got.f1_macro - (2 / 3 + 0 + 2 / 3) / 3) < 1e-12
    grid = metrics.confusion(spark.createDataFrame(rows, "real string, pred string"), [])
    assert grid.count() == 9 and grid.agg(F.sum("n")).first()[0] == 3


def test_mode_ties(spark):
    counts = spark.createDataFrame([(1, "bajo", 2), (1, "medio", 2), (2, "medio", 1), (2, "alto", 1)], "semana int, etiqueta string, n int")
    plain = {r.semana: r.moda for r in folds.modes(counts, ["semana"]).collect()}
    assert plain == {1: "bajo", 2: "medio"}
    preferred = {r.semana: r.moda for r in folds.modes(counts, ["semana"], F.lit("medio")).collect()}
    assert preferred == {1: "medio", 2: "medio"}
    high = {r.semana: r.moda for r in folds.modes(counts, ["semana"], F.lit("alto")).collect()}
    assert high == {1: "bajo", 2: "alto"}


def test_training_rows_do_not_change_with_the_test_year(spark):
    rows = sample()
    spoiled = [(p, y, w, "alto" if y >= 2020 else e) for p, y, w, e in rows]
    train = lambda r: sorted(map(str, folds.forward_chaining(labelled(spark, r), [2020], [2018, 2019, 2021]).filter("rol = 'entrenamiento'").collect()))
    assert train(rows) == train(spoiled) and len(train(rows)) == sum(y < 2020 for _, y, _, _ in rows)


def test_excluded_year_never_trains_but_is_tested(spark):
    got = folds.forward_chaining(labelled(spark, sample()), [2019, 2021], [2018, 2019, 2020], excluded=[2019])
    pairs = {(r.anio_externo, r.anio, r.rol) for r in got.select("anio_externo", "anio", "rol").distinct().collect()}
    assert pairs == {(2019, 2019, "prueba"), (2019, 2018, "entrenamiento"), (2021, 2021, "prueba"), (2021, 2018, "entrenamiento"), (2021, 2020, "entrenamiento")}


def test_key_out_counts_equal_the_filtered_folds(spark):
    df = labelled(spark, sample())
    counts = {(r.pais, r.anio_externo): r for r in folds.key_out_counts(df, "pais", [2020, 2021], [2018, 2019, 2020], [2019]).collect()}
    for (country, year), row in counts.items():
        train, test = folds.key_out_fold(df, "pais", country, year, [2018, 2019, 2020], [2019])
        assert row.entrena_alto == train.filter("etiqueta = 'alto'").count()
        assert row.prueba_bajo == test.filter("etiqueta = 'bajo'").count()


def test_fold_states_and_signature_react_to_one_row(spark):
    rows = sample()
    sign = lambda r: {x.pais: x.firma_sha256 for x in folds.fold_signatures(folds.with_state(folds.key_out_counts(labelled(spark, r), "pais", [2021], [2018, 2019])), "pais").collect()}
    changed = [r if i else (r[0], 2018, r[2], "medio" if r[3] != "medio" else "alto") for i, r in enumerate(rows)]
    a, b = sign(rows), sign(changed)
    assert len(a) == 4 and any(a[k] != b[k] for k in a)
    counts = spark.createDataFrame([(2021, 5, 0, 0, 1, 1, 0), (2022, 5, 1, 0, 1, 0, 1), (2023, 1, 1, 1, 0, 0, 0)], "anio_externo int, entrena_bajo int, entrena_medio int, entrena_alto int, prueba_bajo int, prueba_medio int, prueba_alto int")
    got = {r.anio_externo: (r.estado, r.marca) for r in folds.with_state(counts).collect()}
    assert got == {2021: ("no_entrenable", "recall_alto_no_evaluable"), 2022: ("entrenable_con_clase_ausente", ""), 2023: ("sin_test", "")}


def test_persistence_stays_within_the_year_and_skips_gaps(spark):
    rows = [("a", 2020, 1, "bajo"), ("a", 2020, 2, "alto"), ("a", 2020, 4, "medio"), ("a", 2021, 1, "bajo")]
    got = {(r.anio, r.semana): r.persistencia for r in folds.previous_label(labelled(spark, rows), ["pais"]).collect()}
    assert got == {(2020, 1): None, (2020, 2): "bajo", (2020, 4): None, (2021, 1): None}


def test_stability_and_verdicts(spark):
    d = spark.createDataFrame(
        [("a", 1, 0.5, 0.2, True), ("a", 1, 0.7, 0.4, True), ("a", 2, 0.5, 0.1, True), ("b", 1, 0.5, 0.1, False), ("b", 2, 0.5, None, None)],
        "pais string, anio int, f1_macro double, recall_alto double, exito boolean",
    )
    stable = metrics.stability(d, ["pais", "anio"])
    got = {(r.pais, r.anio): r.exito_estable for r in stable.collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("b", 1): False, ("b", 2): None}
    verdicts = metrics.key_verdicts(stable, "pais")
    assert {r.pais: r.veredicto for r in verdicts.collect()} == {"a": "transferencia_sostenida", "b": "evidencia_insuficiente"}
    assert metrics.overall_verdict(verdicts).first().veredicto == "cerrar_multipais_por_falta_de_transferencia"


def test_forest_learns_weights_and_absent_class_gets_zero(spark):
    rng = random.Random(2)
    rows = [(2020 if i < 150 else 2021, i, "bajo" if x < 0.8 else "medio", x, 1 - x) for i, x in ((i, rng.random()) for i in range(200))]
    df = spark.createDataFrame(rows, "anio int, semana int, etiqueta string, u double, v double")
    assigned = folds.forward_chaining(df, [2021], [2020])
    weights = {r.etiqueta: r.peso for r in folds.class_weights(assigned).collect()}
    n = sum(1 for r in rows if r[0] == 2020 and r[2] == "medio")
    assert abs(weights["medio"] - 150 / (2 * n)) < 1e-12
    preds = forests.fold_predictions(assigned, ["u", "v"], ["anio_externo"], ["anio", "semana"], trees=10, depth=4).collect()
    assert sum(r.pred == r.etiqueta for r in preds) >= 45 and all(r.p_alto == 0.0 for r in preds)


def test_discards_apply_in_order(spark):
    labels = spark.createDataFrame([(2020, 1, None, "m"), (2021, 1, None, "m"), (2021, 2, "alto", None), (2021, 3, "bajo", None)], "anio int, semana int, etiqueta string, motivo string")
    feats = spark.createDataFrame([(2021, 2, 1.0), (2021, 3, None), (2020, 1, 1.0)], "anio int, semana int, x double")
    rows = features.training_set(labels, feats, ["x"], [2020])
    got = {r.motivo: r.filas for r in features.discard_counts(rows).collect()}
    assert got == {"anio_excluido": 1, "m": 1, "filas_finales": 1, "sin_historia_climatica": 1}


def test_variants_are_compared_over_evaluable_folds_only(spark):
    rows = [
        (2001, "a", True, 0.9, 0.9, 0.9, 0.9), (2001, "b", False, 0.5, 0.5, 0.5, 0.5),
        (2002, "a", None, 0.1, 0.1, None, None), (2002, "b", None, 0.9, 0.9, None, None),
    ]
    stable = spark.createDataFrame(
        rows, "anio int, variante string, exito_estable boolean, f1_min double, f1_max double, recall_min double, recall_max double"
    )
    got = metrics.compare_variants(stable, ["anio"], "b", "a").first()
    assert (got.folds, got.exitos_rica, got.exitos_base, got.rica_en_todos, got.base_en_todos, got.clima_justificado) == (1, 1, 0, True, False, True)
    none = metrics.compare_variants(stable.filter("anio = 2002"), ["anio"], "b", "a").first()
    assert (none.folds, none.rica_en_todos, none.clima_justificado) == (0, False, False)


def test_model_queries_are_registered_whole(spark, monkeypatch):
    from checks import evaluation as ev

    columns = {n: 1.0 for n in ev.MODEL_NAMES}
    rows = spark.createDataFrame([("a", y, w, "bajo") for y in range(1995, 2002) for w in (1, 2)],
                                 "region string, anio int, semana int, etiqueta string")
    rows = rows.withColumns({n: F.lit(v) for n, v in columns.items()})
    asked = []

    def predictions(rows, names, fold, row, seeds=(42,), trees=forests.TREES, depth=forests.DEPTH):
        asked.append((sorted({tuple(r[c] for c in fold) for r in rows.collect()}), tuple(seeds), trees, depth))
        return rows.selectExpr("*", "0 AS semilla", "etiqueta AS pred", "1.0 AS p_bajo", "0.0 AS p_medio", "0.0 AS p_alto")

    def compare(train, test, names, trees=300, depth=10, seed=42, rounds=100, iterations=2000):
        asked.append((sorted({r.anio for r in train.collect()}), sorted({r.anio for r in test.collect()}), trees, depth, rounds, iterations))
        return test.selectExpr("*", "etiqueta AS pred", "'bosque' AS algoritmo")

    monkeypatch.setattr(ev, "model_rows", lambda spark, d: rows)
    monkeypatch.setattr(forests, "fold_predictions", predictions)
    monkeypatch.setattr(models, "compare_algorithms", compare)
    ev.m8(spark, "")
    ev.m8_key_out(spark, "")
    years, seeds = [1999, 2000, 2001], (*range(10), 42)
    assert asked == [([(y,) for y in years], seeds, 300, 10), ([("a", y) for y in years], seeds, 300, 10)]
    asked.clear()
    assert {r.anio_externo for r in ev.m21(spark, "").collect()} == {1999, 2000, 2001}
    assert asked == [([1997], [1999], 300, 10, 100, 2000), ([1997, 1999], [2000], 300, 10, 100, 2000),
                     ([1997, 1999, 2000], [2001], 300, 10, 100, 2000)]


def test_algorithms_of_a_comparison_are_fitted_at_once(spark, monkeypatch):
    """Each fit waits for the others to begin, and the result has all three."""
    import threading

    begun, made = threading.Barrier(3, timeout=60), models.Pipeline

    class Waiting(made):
        def fit(self, dataset, params=None):
            begun.wait()
            return super().fit(dataset, params)

    monkeypatch.setattr(models, "Pipeline", Waiting)
    rng = random.Random(2)
    rows = [(i, ("bajo", "medio", "alto")[i % 3], i % 3 + rng.random(), rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "fila int, etiqueta string, a double, b double")
    got = models.compare_algorithms(df.filter("fila >= 30"), df.filter("fila < 30"), ["a", "b"], trees=5, depth=3, rounds=2, iterations=20)
    right = {r.algoritmo: r.n for r in got.filter("pred = etiqueta").groupBy("algoritmo").agg(F.count("*").alias("n")).collect()}
    assert got.count() == 90 and set(right) == {"bosque", "refuerzo", "logistica"} and min(right.values()) > 20

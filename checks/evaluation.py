"""Fold, metric and model queries."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from checks.base import check, history, view
from checks.baselines import EARLIER, KEYS, label_sql, regional
from checks.relational import lab_series
from checks.weather import weekly_wide, with_index
from weekwatch.functions.classify import CLASSES
from weekwatch.operators import channel, features, folds, forests, metrics, models, weekly
from weekwatch.plans import adapters as A
from weekwatch.session import at_once, new_path, stored

EXTERNAL = (1999, 2000, 2001)
TARGETS = (1997, 1999, 2000, 2001)
EXT_SQL = "[1999, 2000, 2001]"

view("filas", "SELECT region, clase, anio, semana, etiqueta FROM etiquetas_reg WHERE etiqueta IS NOT NULL")
view(
    "plegadas",
    f"""SELECT *, CASE WHEN anio = anio_externo THEN 'prueba' ELSE 'entrenamiento' END AS rol
    FROM (SELECT *, unnest({EXT_SQL}) AS anio_externo FROM filas)
    WHERE anio = anio_externo OR (anio < anio_externo AND anio IN {TARGETS} AND anio <> 1998)""",
)


def labelled(spark, d):
    """Labelled rows, written once as an experiment does before its folds."""
    labels = channel.prospective_labels(regional(spark, d), KEYS, [A.EXCLUDED_YEAR], min_obs=6, min_years=2)
    return stored(labels.filter(F.col("motivo").isNull()).select(*KEYS, "anio", "semana", "etiqueta"))


def assigned(spark, d):
    return folds.forward_chaining(labelled(spark, d), EXTERNAL, TARGETS, [A.EXCLUDED_YEAR])


def _class_counts(prefix: str, keep: str) -> str:
    return ", ".join(f"count(*) FILTER ({keep} AND etiqueta = '{c}') AS {prefix}_{c}" for c in CLASSES)


@check("M1_forward_folds", "SELECT * FROM plegadas")
def m1(spark, d):
    return assigned(spark, d)


@check(
    "M2_leave_year_out",
    """SELECT clase, anio_externo, CASE WHEN anio = anio_externo THEN 'prueba' ELSE 'entrenamiento' END AS rol, etiqueta, count(*) AS filas
    FROM (SELECT *, unnest([1997, 1999, 2000, 2001]) AS anio_externo FROM filas) GROUP BY ALL""",
)
def m2(spark, d):
    rows = folds.leave_year_out(labelled(spark, d), TARGETS)
    return rows.groupBy("clase", "anio_externo", "rol", "etiqueta").agg(F.count(F.lit(1)).alias("filas"))


view(
    "pliegues_pais",
    f"""SELECT k.region, k.anio_externo,
        {_class_counts('entrena', f"f.region <> k.region AND f.anio < k.anio_externo AND f.anio IN {TARGETS} AND f.anio <> 1998")},
        {_class_counts('prueba', "f.region = k.region AND f.anio = k.anio_externo")}
    FROM (SELECT region, unnest({EXT_SQL}) AS anio_externo FROM (SELECT DISTINCT region FROM filas)) k, filas f GROUP BY ALL""",
)


def country_folds(spark, d):
    return folds.key_out_counts(labelled(spark, d), "region", EXTERNAL, TARGETS, [A.EXCLUDED_YEAR])


@check("M3_key_out_forward_folds", "SELECT * FROM pliegues_pais")
def m3(spark, d):
    return country_folds(spark, d)


@check(
    "M4_key_against_rest",
    f"""SELECT k.region, k.anio_externo, {_class_counts('entrena', 'f.region <> k.region')},
        {_class_counts('prueba', 'f.region = k.region AND f.anio = k.anio_externo')}
    FROM (SELECT region, unnest([1997, 1999, 2000, 2001]) AS anio_externo FROM (SELECT DISTINCT region FROM filas)) k, filas f GROUP BY ALL""",
)
def m4(spark, d):
    return folds.key_against_rest_counts(labelled(spark, d), "region", TARGETS)


_PRESENT = " + ".join(f"CAST(entrena_{c} > 0 AS INTEGER)" for c in CLASSES)
view(
    "pliegues_estado",
    f"""SELECT *, CASE WHEN n_prueba = 0 THEN 'sin_test' WHEN {_PRESENT} < 2 THEN 'no_entrenable'
            WHEN {_PRESENT} < 3 THEN 'entrenable_con_clase_ausente' ELSE 'entrenable' END AS estado,
        CASE WHEN n_prueba > 0 AND prueba_alto = 0 THEN 'recall_alto_no_evaluable' ELSE '' END AS marca
    FROM (SELECT *, {' + '.join(f'entrena_{c}' for c in CLASSES)} AS n_entrena, {' + '.join(f'prueba_{c}' for c in CLASSES)} AS n_prueba
          FROM pliegues_pais)""",
)


@check("M5_fold_state", "SELECT * FROM pliegues_estado")
def m5(spark, d):
    return folds.with_state(country_folds(spark, d))


def _dist(prefix: str) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {prefix}_{c}" for c in sorted(CLASSES)) + " || '}'"


@check(
    "M6_fold_signature",
    f"""SELECT region, sha256('{{"folds":[' || string_agg(t, ',' ORDER BY anio_externo) || ']}}') AS firma_sha256
    FROM (SELECT region, anio_externo, '{{"anio_externo":' || anio_externo || ',"distribucion_test":' || {_dist('prueba')} ||
            ',"distribucion_train":' || {_dist('entrena')} || ',"estado":"' || estado || '","marcas":[' ||
            CASE WHEN marca = '' THEN '' ELSE '"' || marca || '"' END || '],"n_test":' || n_prueba || ',"n_train":' || n_entrena ||
            ',"pais_externo":"' || region || '"}}' AS t FROM pliegues_estado) GROUP BY region""",
)
def m6(spark, d):
    return folds.fold_signatures(folds.with_state(country_folds(spark, d)), "region")


@check(
    "M6_signature_difference",
    """SELECT region, anio_externo, 'n_prueba' AS campo, CAST(n_prueba + 1 AS VARCHAR) AS esperado, CAST(n_prueba AS VARCHAR) AS observado
    FROM pliegues_estado WHERE region = 3 AND anio_externo = 2000
    UNION ALL SELECT region, anio_externo, 'fold', 'ausente', 'presente' FROM pliegues_estado WHERE region = 5 AND anio_externo = 1999""",
)
def m6_difference(spark, d):
    """Against a frozen table in which one fold has another size and one is missing."""
    own = stored(folds.with_state(country_folds(spark, d)))
    changed = F.col("n_prueba") + F.when((F.col("region") == 3) & (F.col("anio_externo") == 2000), 1).otherwise(0)
    frozen = own.withColumn("n_prueba", changed).filter("NOT (region = 5 AND anio_externo = 1999)")
    return folds.signature_difference(own, frozen, "region")


@check(
    "M7_balanced_weights",
    """SELECT clase, anio_externo, etiqueta, n, (sum(n) OVER w) / (count(*) OVER w * n) AS peso
    FROM (SELECT clase, anio_externo, etiqueta, count(*) AS n FROM plegadas WHERE rol = 'entrenamiento' GROUP BY ALL)
    WINDOW w AS (PARTITION BY clase, anio_externo)""",
)
def m7(spark, d):
    return folds.class_weights(assigned(spark, d), ["clase"])


_ORDER = "CASE etiqueta WHEN 'bajo' THEN 0 WHEN 'medio' THEN 1 ELSE 2 END"
view(
    "moda_global",
    f"""SELECT clase, anio_externo, etiqueta AS constante_mayoritaria FROM (
        SELECT clase, anio_externo, etiqueta, count(*) AS n FROM plegadas WHERE rol = 'entrenamiento' GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY clase, anio_externo ORDER BY n DESC, {_ORDER}) = 1""",
)
view(
    "moda_semana",
    f"""SELECT clase, anio_externo, semana, etiqueta AS moda FROM (
        SELECT clase, anio_externo, semana, etiqueta, count(*) AS n FROM plegadas WHERE rol = 'entrenamiento' GROUP BY ALL)
        JOIN moda_global USING (clase, anio_externo)
    QUALIFY row_number() OVER (PARTITION BY clase, anio_externo, semana
        ORDER BY n DESC, CAST(etiqueta = constante_mayoritaria AS INTEGER) DESC, {_ORDER}) = 1""",
)
view(
    "referencias",
    """SELECT t.region, t.clase, t.anio, t.semana, t.etiqueta, t.anio_externo, g.constante_mayoritaria,
        coalesce(m.moda, g.constante_mayoritaria) AS climatologica, 'alto' AS siempre_alto, p.etiqueta AS persistencia
    FROM plegadas t JOIN moda_global g USING (clase, anio_externo)
    LEFT JOIN moda_semana m ON m.clase = t.clase AND m.anio_externo = t.anio_externo AND m.semana = t.semana
    LEFT JOIN plegadas p ON p.rol = 'prueba' AND p.clase = t.clase AND p.region = t.region AND p.anio = t.anio
        AND p.anio_externo = t.anio_externo AND p.semana = t.semana - 1
    WHERE t.rol = 'prueba'""",
)


def refs(spark, d):
    return folds.references(assigned(spark, d), ["clase"], ["region"])


@check("A16_weekly_mode", "SELECT * FROM moda_semana")
def a16(spark, d):
    train = assigned(spark, d).filter("rol = 'entrenamiento'")
    fold = ["clase", "anio_externo"]
    counts = train.groupBy(*fold, "semana", "etiqueta").agg(F.count(F.lit(1)).alias("n"))
    overall = folds.modes(counts.groupBy(*fold, "etiqueta").agg(F.sum("n").alias("n")), fold)
    joined = counts.join(overall.withColumnRenamed("moda", "global"), fold)
    return folds.modes(joined, [*fold, "semana"], F.col("global"))


@check("J10_default_filled_lookup", "SELECT region, clase, anio, semana, climatologica FROM referencias")
def j10(spark, d):
    return refs(spark, d).select("region", "clase", "anio", "semana", "climatologica")


@check("M9_reference_predictions", "SELECT * FROM referencias")
def m9(spark, d):
    return refs(spark, d)


@check(
    "W18_persistence",
    """SELECT t.region, t.clase, t.anio, t.semana, t.etiqueta, p.etiqueta AS persistencia FROM filas t LEFT JOIN filas p
    ON p.region = t.region AND p.clase = t.clase AND p.anio = t.anio AND p.semana = t.semana - 1""",
)
def w18(spark, d):
    return folds.previous_label(labelled(spark, d), KEYS)


@check(
    "W18_persistence_over_all_labels",
    """SELECT t.region, t.clase, t.anio, t.semana, p.etiqueta AS persistencia FROM plegadas t LEFT JOIN filas p
    ON p.region = t.region AND p.clase = t.clase AND p.anio = t.anio AND p.semana = t.semana - 1
    WHERE t.rol = 'prueba' AND t.semana % 5 <> 1 AND EXISTS (FROM plegadas e WHERE e.rol = 'entrenamiento' AND e.semana % 5 <> 1
        AND e.clase = t.clase AND e.anio_externo = t.anio_externo)""",
)
def w18_all(spark, d):
    """Rows of every fifth week are discarded from the folds; their labels still serve as predecessors."""
    rows = labelled(spark, d)
    kept = rows.filter(F.col("semana") % 5 != 1)
    parts = folds.forward_chaining(kept, EXTERNAL, TARGETS, [A.EXCLUDED_YEAR])
    found = folds.references(parts, ["clase"], ["region"], rows)
    return found.select("region", "clase", "anio", "semana", "persistencia")


# --- metrics on deterministic pseudo-predictions --------------------------

view(
    "preds",
    """SELECT region, clase, anio, semana, etiqueta AS real, ['bajo', 'medio', 'alto'][(53 * anio + semana + region) % 3 + 1] AS pred,
        ((31 * anio + 17 * semana + 7 * region) % 100) / 100.0::DOUBLE AS p_alto FROM filas""",
)
view("preds_grupo", "SELECT clase || '-' || anio AS pliegue, * FROM preds")


def predictions(spark, d):
    number = (53 * F.col("anio") + F.col("semana") + F.col("region")) % 3
    score = ((31 * F.col("anio") + 17 * F.col("semana") + 7 * F.col("region")) % 100) / F.lit(100.0)
    return labelled(spark, d).select(
        *KEYS, "anio", "semana", F.col("etiqueta").alias("real"), models._class_name(number).alias("pred"), score.alias("p_alto")
    )


GROUP = ["clase", "anio"]
GROUP_SQL = "clase, anio"


def metric_sql(source: str, groups: str) -> str:
    """Class metrics of a (real, pred) table, in SQL."""
    counts = ", ".join(
        f"count(*) FILTER (real = '{c}' AND pred = '{c}') AS tp_{c}, count(*) FILTER (pred = '{c}') AS pr_{c}, "
        f"count(*) FILTER (real = '{c}' AND pred IS NOT NULL) AS soporte_{c}" for c in CLASSES
    )
    rates = ", ".join(
        f"CASE WHEN pr_{c} > 0 THEN tp_{c} / pr_{c} ELSE 0 END::DOUBLE AS precision_{c}, "
        f"CASE WHEN soporte_{c} > 0 THEN tp_{c} / soporte_{c} ELSE 0 END::DOUBLE AS recall_{c}" for c in CLASSES
    )
    f1 = ", ".join(
        f"CASE WHEN precision_{c} + recall_{c} > 0 THEN 2 * precision_{c} * recall_{c} / (precision_{c} + recall_{c}) ELSE 0 END::DOUBLE AS f1_{c}"
        for c in CLASSES
    )
    return f"""SELECT * EXCLUDE ({', '.join(f'tp_{c}, pr_{c}' for c in CLASSES)}), (f1_bajo + f1_medio + f1_alto) / 3 AS f1_macro,
            CASE WHEN soporte_alto > 0 THEN recall_alto END AS recall_alto_evaluable, tp_alto AS aciertos_alto, pr_alto - tp_alto AS falsos_positivos_alto
        FROM (SELECT *, {f1} FROM (SELECT *, {rates} FROM (
            SELECT {groups}, {counts}, count(*) FILTER (pred IS NULL) AS filas_excluidas FROM {source} GROUP BY {groups})))"""


@check(
    "M10_confusion_matrix",
    """SELECT g.clase, g.anio, r.c AS real, p.c AS pred, count(x.real) AS n FROM (SELECT DISTINCT clase, anio FROM preds) g
    CROSS JOIN (SELECT unnest(['bajo', 'medio', 'alto']) AS c) r CROSS JOIN (SELECT unnest(['bajo', 'medio', 'alto']) AS c) p
    LEFT JOIN preds x ON x.clase = g.clase AND x.anio = g.anio AND x.real = r.c AND x.pred = p.c GROUP BY ALL""",
)
def m10(spark, d):
    return metrics.confusion(predictions(spark, d), GROUP)


view("metricas", metric_sql("preds", GROUP_SQL))


@check("M11_class_metrics", "SELECT * FROM metricas")
def m11(spark, d):
    return metrics.class_metrics(predictions(spark, d), GROUP)


_REF_LIST = ", ".join(folds.REFERENCES)
view(
    "refs_largas",
    f"""SELECT clase, anio, etiqueta AS real, referencia, nullif(pred, '-') AS pred
    FROM (SELECT * REPLACE (coalesce(persistencia, '-') AS persistencia) FROM referencias) UNPIVOT (pred FOR referencia IN ({_REF_LIST}))""",
)
view("metricas_refs", metric_sql("refs_largas", "clase, anio, referencia"))


def reference_metrics(spark, d):
    long = refs(spark, d).unpivot(["clase", "anio", "etiqueta"], list(folds.REFERENCES), "referencia", "pred")
    return metrics.class_metrics(long, ["clase", "anio", "referencia"], real="etiqueta")


@check(
    "M12_high_class_counts",
    "SELECT clase, anio, referencia, aciertos_alto, soporte_alto, falsos_positivos_alto, recall_alto_evaluable, filas_excluidas FROM metricas_refs",
)
def m12(spark, d):
    return reference_metrics(spark, d).select(
        "clase", "anio", "referencia", "aciertos_alto", "soporte_alto", "falsos_positivos_alto", "recall_alto_evaluable", "filas_excluidas"
    )


@check(
    "M13_roc_auc",
    """WITH s AS (SELECT clase, anio, p_alto, count(*) FILTER (real = 'alto') AS p, count(*) FILTER (real <> 'alto') AS n FROM preds GROUP BY ALL),
    g AS (SELECT clase, anio, sum(p) AS tp, sum(n) AS tn FROM s GROUP BY ALL)
    SELECT g.clase, g.anio, CASE WHEN tp * tn > 0 THEN round((SELECT sum(a.p * b.n * CASE WHEN a.p_alto > b.p_alto THEN 1.0 WHEN a.p_alto = b.p_alto THEN 0.5 ELSE 0 END)
        FROM s a JOIN s b ON a.clase = b.clase AND a.anio = b.anio WHERE a.clase = g.clase AND a.anio = g.anio)::DOUBLE / (tp * tn)::DOUBLE, 9) END AS auc FROM g""",
)
def m13(spark, d):
    return metrics.roc_auc(predictions(spark, d), GROUP, "p_alto").withColumn("auc", F.round("auc", 9))


view(
    "curva",
    """SELECT clase, anio, p_alto AS umbral, tp / (tp + fp) AS precision, tp / total AS recall, p / total AS paso FROM (
        SELECT clase, anio, p_alto, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY clase, anio) AS total FROM (
            SELECT clase, anio, p_alto, count(*) FILTER (real = 'alto') AS p, count(*) FILTER (real <> 'alto') AS n FROM preds GROUP BY ALL)
        WINDOW w AS (PARTITION BY clase, anio ORDER BY p_alto DESC)) WHERE total > 0""",
)


@check(
    "M14_precision_recall_curve",
    "SELECT clase, anio, umbral, precision, recall FROM curva UNION ALL SELECT DISTINCT clase, anio, NULL, 1::DOUBLE, 0::DOUBLE FROM curva",
)
def m14(spark, d):
    points = metrics.precision_recall_points(predictions(spark, d), GROUP, "p_alto")
    return metrics.precision_recall_curve(points, GROUP)


@check(
    "M14_average_precision",
    "SELECT clase, anio, round(sum(paso * precision), 9) AS precision_media FROM curva GROUP BY ALL",
)
def m14_ap(spark, d):
    points = metrics.precision_recall_points(predictions(spark, d), GROUP, "p_alto")
    ap = metrics.average_precision(points, GROUP)
    return ap.withColumn("precision_media", F.round("precision_media", 9))


THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
view(
    "preds_umbral",
    f"""SELECT clase, anio, umbral, real, CASE WHEN p_alto > umbral THEN 'alto' ELSE pred END AS pred
    FROM (SELECT *, unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS umbral FROM preds)""",
)
view("metricas_umbral", metric_sql("preds_umbral", "clase, anio, umbral"))


@check(
    "M15_threshold_sweep",
    "SELECT clase, anio, umbral, recall_alto, precision_alto, aciertos_alto, soporte_alto, f1_macro FROM metricas_umbral",
)
def m15(spark, d):
    return metrics.threshold_sweep(predictions(spark, d), GROUP, "p_alto", THRESHOLDS)


SEEDS = tuple(range(10))
view(
    "preds_semilla",
    f"""SELECT region, clase, anio, semilla, real, CASE WHEN (semana + semilla) % (3 + variante * 4) = 0
            THEN ['bajo', 'medio', 'alto'][(53 * anio + semana + region + semilla) % 3 + 1] ELSE real END AS pred,
        CASE variante WHEN 0 THEN 'solo_casos' ELSE 'casos_mas_clima' END AS variante
    FROM (SELECT *, unnest({list(SEEDS)}) AS semilla FROM (SELECT *, unnest([0, 1]) AS variante FROM preds)) WHERE anio IN {EXTERNAL}""",
)


def seeded(spark, d):
    noisy = (F.col("semana") + F.col("semilla")) % (3 + F.col("v") * 4) == 0
    other = models._class_name((53 * F.col("anio") + F.col("semana") + F.col("region") + F.col("semilla")) % 3)
    return (
        predictions(spark, d)
        .filter(F.col("anio").isin(*EXTERNAL))
        .withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("semilla", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
        .withColumn("pred", F.when(noisy, other).otherwise(F.col("real")))
        .withColumn("variante", F.when(F.col("v") == 0, "solo_casos").otherwise("casos_mas_clima"))
        .drop("v")
    )


def _decision_sql(model: str, extra: str) -> str:
    return f"""SELECT m.clase, m.anio, {extra}, m.f1_macro, m.recall_alto_evaluable AS recall_alto,
        CASE WHEN m.recall_alto_evaluable IS NULL THEN 'recall_alto_no_evaluable' ELSE 'evaluable' END AS estado,
        CASE WHEN m.recall_alto_evaluable IS NOT NULL THEN coalesce(m.f1_macro > c.f1_macro AND m.recall_alto_evaluable > c.recall_alto_evaluable, FALSE) END AS supera_climatologica,
        greatest(k.f1_macro, a.f1_macro) > m.f1_macro AS veto_constantes,
        CASE WHEN m.recall_alto_evaluable IS NOT NULL THEN coalesce(m.f1_macro > c.f1_macro AND m.recall_alto_evaluable > c.recall_alto_evaluable, FALSE)
            AND NOT greatest(k.f1_macro, a.f1_macro) > m.f1_macro END AS exito
    FROM {model} m JOIN metricas_refs c ON c.referencia = 'climatologica' AND c.clase = m.clase AND c.anio = m.anio
    JOIN metricas_refs k ON k.referencia = 'constante_mayoritaria' AND k.clase = m.clase AND k.anio = m.anio
    JOIN metricas_refs a ON a.referencia = 'siempre_alto' AND a.clase = m.clase AND a.anio = m.anio"""


view("metricas_semilla", metric_sql("preds_semilla", "clase, anio, variante, semilla"))
view("decisiones", _decision_sql("metricas_semilla", "variante, semilla"))


def decisions(spark, d):
    model = metrics.class_metrics(seeded(spark, d), [*GROUP, "variante", "semilla"])
    return metrics.decision(model, reference_metrics(spark, d), GROUP, ["variante", "semilla"])


@check("M16_decision_rule", "SELECT * FROM decisiones")
def m16(spark, d):
    return decisions(spark, d)


def stability_sql(source: str, groups: str) -> str:
    return f"""SELECT {groups}, count(*) AS n_semillas, min(f1_macro) AS f1_min, round(avg(f1_macro), 9) AS f1_media, max(f1_macro) AS f1_max,
        round(stddev_pop(f1_macro), 9) AS f1_desv, min(recall_alto) AS recall_min, round(avg(recall_alto), 9) AS recall_media, max(recall_alto) AS recall_max,
        count(*) FILTER (exito) AS exitos, count(exito) AS semillas_evaluables,
        CASE WHEN count(exito) = count(*) THEN bool_and(exito) END AS exito_estable FROM {source} GROUP BY {groups}"""


view("estabilidad", stability_sql("decisiones", "clase, anio, variante"))


def _rounded_stability(table):
    return table.withColumns({c: F.round(c, 9) for c in ("f1_media", "f1_desv", "recall_media")})


@check("M17_seed_stability", "SELECT * FROM estabilidad")
def m17(spark, d):
    return _rounded_stability(metrics.stability(decisions(spark, d), [*GROUP, "variante"]))


view("metricas_region", metric_sql("preds_semilla", "region, anio, variante, semilla"))
view(
    "pliegues_region",
    """SELECT region, anio, CASE WHEN bool_and(recall_alto_evaluable IS NOT NULL) THEN bool_and(f1_macro > 0.8 AND recall_alto_evaluable > 0.5) END AS exito_estable
    FROM metricas_region WHERE variante = 'casos_mas_clima' GROUP BY ALL""",
)


def region_folds(spark, d):
    per_seed = metrics.class_metrics(
        seeded(spark, d).filter("variante = 'casos_mas_clima'"), ["region", "anio", "semilla"]
    )
    recall = F.col("recall_alto_evaluable")
    judged = per_seed.select(
        "region", "anio", "f1_macro", recall.alias("recall_alto"),
        F.when(recall.isNotNull(), (F.col("f1_macro") > 0.8) & (recall > 0.5)).alias("exito"),
    )
    return metrics.stability(judged, ["region", "anio"])


view(
    "veredictos",
    """SELECT region, count(*) AS folds_totales, count(exito_estable) AS folds_evaluables, count(*) FILTER (exito_estable) AS folds_exito_estable,
        CASE WHEN count(exito_estable) < 2 THEN 'evidencia_insuficiente' WHEN count(*) FILTER (exito_estable) = count(exito_estable)
            THEN 'transferencia_sostenida' ELSE 'transferencia_no_sostenida' END AS veredicto FROM pliegues_region GROUP BY region""",
)


@check("M18_key_verdicts", "SELECT * FROM veredictos")
def m18(spark, d):
    return metrics.key_verdicts(region_folds(spark, d), "region")


@check(
    "M18_overall_verdict",
    """SELECT *, CASE WHEN sostenidos <= 8 THEN 'cerrar_multipais_por_falta_de_transferencia' WHEN sostenidos <= 11 THEN 'inconcluso'
        ELSE 'transferencia_mayoritaria_confirmada' END AS veredicto
    FROM (SELECT count(*) FILTER (veredicto = 'transferencia_sostenida') AS sostenidos, count(*) AS evaluados FROM veredictos)""",
)
def m18_overall(spark, d):
    return metrics.overall_verdict(metrics.key_verdicts(region_folds(spark, d), "region"))


@check(
    "M19_variant_comparison",
    """WITH p AS (SELECT r.clase, r.anio, r.exito_estable AS er, b.exito_estable AS eb,
            r.exito_estable IS NOT NULL AND b.exito_estable IS NOT NULL AS ev,
            coalesce(r.f1_min >= b.f1_max + 0.05 AND r.recall_min >= b.recall_max, FALSE) AS mejor
        FROM estabilidad r JOIN estabilidad b ON b.clase = r.clase AND b.anio = r.anio AND b.variante = 'solo_casos' WHERE r.variante = 'casos_mas_clima')
    SELECT clase, count(*) FILTER (ev) AS folds, count(*) FILTER (ev AND eb) AS exitos_base,
        count(*) FILTER (ev AND er) AS exitos_rica, coalesce(bool_and(eb) FILTER (ev), FALSE) AS base_en_todos,
        coalesce(bool_and(er) FILTER (ev), FALSE) AS rica_en_todos,
        coalesce(bool_or(er AND NOT eb) FILTER (ev) OR bool_and(mejor) FILTER (ev), FALSE) AS clima_justificado
    FROM p GROUP BY clase""",
)
def m19(spark, d):
    stable = metrics.stability(decisions(spark, d), [*GROUP, "variante"])
    return metrics.compare_variants(stable, ["anio"], "solo_casos", "casos_mas_clima", ["clase"])


# --- models ---------------------------------------------------------------

MODEL_VARS = ("temp_media", "precipitation_sum", "humedad_relativa_media")
MODEL_NAMES = features.feature_names(MODEL_VARS)
#: Ten seeds for stability and the reference seed.
MODEL_SEEDS = (*range(10), 42)


def model_rows(spark, d):
    """Labelled region weeks with regional lags, complete rows only."""
    labels = channel.prospective_labels(lab_series(spark, d), ["region"], [A.EXCLUDED_YEAR], min_obs=6, min_years=2).drop("claves")
    wide = weekly.known(weekly_wide(spark, d), MODEL_VARS, complete=False)
    lags = features.lagged(with_index(wide), ["region"], MODEL_VARS)
    rows = features.training_set(labels, lags, MODEL_NAMES, [A.EXCLUDED_YEAR], ["region"])
    usable = rows.filter(F.col("motivo").isNull()).select("region", "anio", "semana", "etiqueta", *MODEL_NAMES)
    return stored(usable)


view("serie_modelos", "SELECT region, anio, semana, sum(conteo)::DOUBLE AS valor FROM obs WHERE clase IN ('probable', 'confirmado') GROUP BY ALL")
view("hist_modelos", history("serie_modelos", "region", 1, EARLIER))
view("etiquetas_modelos", label_sql("hist_modelos", 6, 2))
view("tres_i", "SELECT t.*, CAST(date_diff('day', DATE '1970-01-04', fecha_inicio) // 7 AS INTEGER) AS indice FROM tres t JOIN cal USING (anio, semana)")
_BEFORE = " ".join(
    f"JOIN tres_i l{k} ON l{k}.region = t.region AND l{k}.indice = t.indice - {k} AND " + " AND ".join(f"l{k}.{v} IS NOT NULL" for v in MODEL_VARS)
    for k in range(1, 5)
)
view(
    "modelables",
    f"""SELECT e.region, e.anio, e.semana, e.etiqueta FROM etiquetas_modelos e JOIN tres_i t ON t.region = e.region AND t.anio = e.anio AND t.semana = e.semana
    {_BEFORE} WHERE e.anio <> 1998 AND e.etiqueta IS NOT NULL""",
)


@check("Q10_regional_training_rows", "SELECT * FROM modelables")
def q10_regional(spark, d):
    return model_rows(spark, d).select("region", "anio", "semana", "etiqueta")


ROW = ["region", "anio", "semana"]


def forward_forests(spark, d):
    rows = stored(folds.forward_chaining(model_rows(spark, d), EXTERNAL, TARGETS, [A.EXCLUDED_YEAR]))
    return forests.fold_predictions(rows, MODEL_NAMES, ["anio_externo"], ROW, MODEL_SEEDS)


def key_out_forests(spark, d):
    rows = stored(folds.key_out_forward(model_rows(spark, d), "region", EXTERNAL, TARGETS, [A.EXCLUDED_YEAR]))
    return forests.fold_predictions(rows, MODEL_NAMES, ["clave_externa", "anio_externo"], ROW, MODEL_SEEDS)


def prediction_facts(preds, *keys):
    """What SQL can say of predictions: keys, sum of the probabilities, prediction is a class of the highest one."""
    chances = [F.col(f"p_{c}") for c in CLASSES]
    own = F.element_at(F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.col(f"p_{c}"))]), F.col("pred"))
    total = F.round(chances[0] + chances[1] + chances[2], 6)
    return preds.select(*keys, *ROW, "semilla", "etiqueta", total.alias("suma"), (own == F.greatest(*chances)).alias("es_maxima"))


_SEED_SQL = f"unnest({list(MODEL_SEEDS)})"


@check("M8_forest_fold_predictions")
def m8(spark, d):
    return forward_forests(spark, d).select(*ROW, "semilla", "etiqueta", "pred", "p_bajo", "p_medio", "p_alto")


@check(
    "M8_prediction_facts",
    f"""SELECT region, anio, semana, {_SEED_SQL} AS semilla, etiqueta, 1::DOUBLE AS suma, TRUE AS es_maxima FROM modelables m
    WHERE anio IN {EXTERNAL} AND (SELECT count(DISTINCT etiqueta) FROM modelables t WHERE t.anio < m.anio AND t.anio IN {TARGETS}) >= 2""",
)
def m8_facts(spark, d):
    return prediction_facts(forward_forests(spark, d).filter("semilla IS NOT NULL"))


@check(
    "M8_key_out_prediction_facts",
    f"""SELECT region AS clave_externa, region, anio, semana, s.semilla, etiqueta, CASE WHEN s.semilla IS NOT NULL THEN 1::DOUBLE END AS suma,
        CASE WHEN s.semilla IS NOT NULL THEN TRUE END AS es_maxima
    FROM (SELECT m.*, (SELECT count(DISTINCT etiqueta) FROM modelables t WHERE t.region <> m.region AND t.anio < m.anio AND t.anio IN {TARGETS}) AS clases
          FROM modelables m WHERE anio IN {EXTERNAL}) m
    JOIN (SELECT {_SEED_SQL} AS semilla UNION ALL SELECT NULL) s ON (s.semilla IS NULL) = (m.clases < 2)""",
)
def m8_key_out(spark, d):
    """Forests of all (left-out region, year) folds and seeds; a fold of fewer than two classes gives rows without seed."""
    return prediction_facts(key_out_forests(spark, d), "clave_externa")


@check("M20_feature_importance")
def m20(spark, d):
    model = models.fit_forest(model_rows(spark, d), MODEL_NAMES)
    return models.importances(model, MODEL_NAMES)


@check("M21_algorithm_comparison")
def m21(spark, d):
    rows = stored(folds.forward_chaining(model_rows(spark, d), EXTERNAL, TARGETS, [A.EXCLUDED_YEAR]))

    def compared(year):
        own = rows.filter(F.col("anio_externo") == year)
        test = own.filter("rol = 'prueba'").select("anio_externo", "region", "anio", "semana", "etiqueta", *MODEL_NAMES)
        return models.compare_algorithms(own.filter("rol = 'entrenamiento'"), test, MODEL_NAMES)

    preds = reduce(DataFrame.unionByName, at_once(spark, [partial(compared, year) for year in EXTERNAL]))
    scores = metrics.class_metrics(preds, ["anio_externo", "algoritmo"], real="etiqueta")
    return scores.select("anio_externo", "algoritmo", "f1_macro", "recall_alto", "soporte_alto")


def _stored(spark, d):
    rows = model_rows(spark, d)
    path = new_path(spark, "modelo")
    models.fit_forest(rows, MODEL_NAMES).write().save(path)
    return rows, path


@check("M22_score_stored_model")
def m22(spark, d):
    rows, path = _stored(spark, d)
    return models.score_week(path, rows, 2000, 20).select("region", "anio", "semana", "etiqueta", "pred", "p_bajo", "p_medio", "p_alto")


@check("Q2_risk_of_latest_week")
def q2(spark, d):
    rows, path = _stored(spark, d)
    return models.score_week(path, rows).select("region", "anio", "semana", "etiqueta", "pred", "p_bajo", "p_medio", "p_alto")


def _scores(scored):
    """Keys, sum of the rounded probabilities to three decimals, and whether the prediction has the highest one."""
    facts = prediction_facts(scored.withColumn("semilla", F.lit(0)))
    return facts.drop("semilla").withColumn("suma", F.round("suma", 2))


@check("M20_importance_facts", "SELECT 9::BIGINT AS variables, 1::DOUBLE AS suma")
def m20_facts(spark, d):
    return m20(spark, d).agg(F.count(F.lit(1)).alias("variables"), F.round(F.sum("importancia"), 6).alias("suma"))


@check(
    "M21_comparison_facts",
    f"""SELECT y AS anio_externo, algoritmo, (SELECT count(*) FROM modelables WHERE anio = y AND etiqueta = 'alto') AS soporte_alto, TRUE AS en_rango
    FROM (SELECT unnest({list(EXTERNAL)}) AS y) CROSS JOIN (SELECT unnest(['bosque', 'refuerzo', 'logistica']) AS algoritmo)
    WHERE EXISTS (FROM modelables WHERE anio = y)""",
)
def m21_facts(spark, d):
    good = F.col("f1_macro").between(0.0, 1.0) & F.col("recall_alto").between(0.0, 1.0)
    return m21(spark, d).select("anio_externo", "algoritmo", F.col("soporte_alto").cast("bigint").alias("soporte_alto"), good.alias("en_rango"))


@check(
    "M22_score_facts",
    "SELECT region, anio, semana, etiqueta, 1::DOUBLE AS suma, TRUE AS es_maxima FROM modelables WHERE anio = 2000 AND semana = 20",
)
def m22_facts(spark, d):
    return _scores(m22(spark, d))


@check(
    "Q2_risk_facts",
    """SELECT region, anio, semana, etiqueta, 1::DOUBLE AS suma, TRUE AS es_maxima FROM modelables
    WHERE (anio, semana) = (SELECT (anio, semana) FROM modelables ORDER BY anio DESC, semana DESC LIMIT 1)""",
)
def q2_facts(spark, d):
    return _scores(q2(spark, d))

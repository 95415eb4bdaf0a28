"""Evaluation metrics for every fold of an experiment in one grouped job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.classify import CLASSES
from weekwatch.operators.ranking import running_totals

HIGH = CLASSES[-1]


def _hit(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def confusion(preds: DataFrame, groups: Sequence[str], real: str = "real", pred: str = "pred") -> DataFrame:
    """Row per group, real and predicted class on the full class grid, zeros included."""
    cells = [
        F.struct(
            F.lit(r).alias("real"),
            F.lit(p).alias("pred"),
            F.count_if(_hit((F.col(real) == r) & (F.col(pred) == p))).alias("n"),
        )
        for r in CLASSES
        for p in CLASSES
    ]
    return preds.groupBy(*groups).agg(F.array(*cells).alias("celdas")).select(*groups, F.inline("celdas"))


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0/0 = 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _f1(c: str) -> Column:
    p, r = F.col(f"precision_{c}"), F.col(f"recall_{c}")
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def class_metrics(preds: DataFrame, groups: Sequence[str], real: str = "real", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, macro F1 over all classes, high-class counts.

    Rows without a prediction are left out and counted in ``filas_excluidas``.
    """
    w = F.col(weight) if weight else F.lit(1)
    total = lambda keep: F.sum(F.when(_hit(keep), w).otherwise(0))
    r, p = F.col(real), F.col(pred)
    judged = p.isNotNull()
    sums = []
    for c in CLASSES:
        sums += [
            total((r == c) & (p == c)).alias(f"_tp_{c}"),
            total(p == c).alias(f"_pred_{c}"),
            total((r == c) & judged).alias(f"soporte_{c}"),
        ]
    counted = preds.groupBy(*groups).agg(*sums, total(p.isNull()).alias("filas_excluidas"))
    rates = {}
    for c in CLASSES:
        rates[f"precision_{c}"] = _ratio(F.col(f"_tp_{c}"), F.col(f"_pred_{c}"))
        rates[f"recall_{c}"] = _ratio(F.col(f"_tp_{c}"), F.col(f"soporte_{c}"))
    scored = counted.withColumns(rates).withColumns({f"f1_{c}": _f1(c) for c in CLASSES})
    macro = sum((F.col(f"f1_{c}") for c in CLASSES[1:]), F.col(f"f1_{CLASSES[0]}")) / len(CLASSES)
    return scored.withColumns(
        {
            "f1_macro": macro,
            "recall_alto_evaluable": F.when(F.col("soporte_alto") > 0, F.col("recall_alto")),
            "aciertos_alto": F.col("_tp_alto"),
            "falsos_positivos_alto": F.col("_pred_alto") - F.col("_tp_alto"),
        }
    ).drop(*[f"_{kind}_{c}" for kind in ("tp", "pred") for c in CLASSES])


def _scored(preds: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    high = (F.col("real") == HIGH).cast("bigint")
    return preds.select(*groups, score, high.alias("positivos"), (1 - high).alias("negativos"))


def roc_auc(preds: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """Area under the ROC curve of the high class; tied scores count half; null with one class."""
    ranked = running_totals(_scored(preds, groups, score), score, ["positivos", "negativos"], groups)
    wins = F.sum(F.col("positivos") * (F.col("negativos_antes") + F.col("negativos") / 2))
    pairs = F.max("positivos_grupo") * F.max("negativos_grupo")
    return ranked.groupBy(*groups).agg(F.when(pairs > 0, wins / pairs).alias("auc"))


def precision_recall_points(preds: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """One point per distinct threshold: precision and recall of score >= threshold."""
    ranked = running_totals(
        _scored(preds, groups, score), score, ["positivos", "negativos"], groups, descending=True
    )
    hits = F.col("positivos_antes") + F.col("positivos")
    flagged = hits + F.col("negativos_antes") + F.col("negativos")
    return ranked.filter(F.col("positivos_grupo") > 0).select(
        *groups,
        F.col(score).alias("umbral"),
        (hits / flagged).alias("precision"),
        (hits / F.col("positivos_grupo")).alias("recall"),
        (F.col("positivos") / F.col("positivos_grupo")).alias("paso"),
    )


def precision_recall_curve(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Points of the curve with its closing point (precision 1, recall 0, no threshold)."""
    last = points.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("umbral"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.drop("paso").unionByName(last)


def average_precision(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sum of recall steps weighted by precision."""
    return points.groupBy(*groups).agg(F.sum(F.col("paso") * F.col("precision")).alias("precision_media"))


def threshold_sweep(preds: DataFrame, groups: Sequence[str], score: str, thresholds: Sequence[float]) -> DataFrame:
    """Metrics when rows whose score exceeds a threshold are overridden to the high class.

    Rows are counted per bucket, the number of thresholds their score exceeds; a threshold then overrides the buckets
    above its own. Only the few counts of each group meet the thresholds, never rows or scores.
    """
    cuts = sorted({float(t) for t in thresholds})
    exceeded = sum((F.when(F.col(score) > t, 1).otherwise(0) for t in cuts[1:]), F.when(F.col(score) > cuts[0], 1).otherwise(0))
    counts = preds.groupBy(*groups, exceeded.alias("_cubo"), "real", "pred").agg(F.count(F.lit(1)).alias("n"))
    places = F.inline(F.array(*[F.struct(F.lit(i).alias("_lugar"), F.lit(t).alias("umbral")) for i, t in enumerate(cuts)]))
    overridden = counts.select("*", places).withColumn("pred", F.when(F.col("_cubo") > F.col("_lugar"), HIGH).otherwise(F.col("pred")))
    return class_metrics(overridden, [*groups, "umbral"], weight="n").select(
        *groups, "umbral", "recall_alto", "precision_alto", "aciertos_alto", "soporte_alto", "f1_macro"
    )


def decision(model: DataFrame, refs: DataFrame, groups: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Whether a model beats the weekly mode on F1 and high-class recall, unless a constant has higher F1.

    ``model`` and ``refs`` are class_metrics tables; ``refs`` has ``referencia``.
    """
    pick = lambda name, column: F.max(F.when(F.col("referencia") == name, F.col(column)))
    wide = refs.groupBy(*groups).agg(
        pick("climatologica", "f1_macro").alias("_f1_clima"),
        pick("climatologica", "recall_alto_evaluable").alias("_recall_clima"),
        F.greatest(pick("constante_mayoritaria", "f1_macro"), pick("siempre_alto", "f1_macro")).alias("_f1_constante"),
    )
    recall = F.col("recall_alto_evaluable")
    beats = F.coalesce(
        (F.col("f1_macro") > F.col("_f1_clima")) & (recall > F.col("_recall_clima")), F.lit(False)
    )
    veto = F.col("_f1_constante") > F.col("f1_macro")
    evaluable = recall.isNotNull()
    return model.join(wide, list(groups)).select(
        *groups,
        *extra,
        "f1_macro",
        recall.alias("recall_alto"),
        F.when(evaluable, "evaluable").otherwise("recall_alto_no_evaluable").alias("estado"),
        F.when(evaluable, beats).alias("supera_climatologica"),
        veto.alias("veto_constantes"),
        F.when(evaluable, beats & ~veto).alias("exito"),
    )


def stability(decisions: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Spread over seeds; a fold is stable only when every seed succeeds, null if any is not evaluable."""
    success = F.col("exito")
    return decisions.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_semillas"),
        F.min("f1_macro").alias("f1_min"),
        F.avg("f1_macro").alias("f1_media"),
        F.max("f1_macro").alias("f1_max"),
        F.stddev_pop("f1_macro").alias("f1_desv"),
        F.min("recall_alto").alias("recall_min"),
        F.avg("recall_alto").alias("recall_media"),
        F.max("recall_alto").alias("recall_max"),
        F.count_if(_hit(success)).alias("exitos"),
        F.count(success).alias("semillas_evaluables"),
        F.when(F.count(success) == F.count(F.lit(1)), F.bool_and(success)).alias("exito_estable"),
    )


def key_verdicts(folds: DataFrame, key: str, min_folds: int = 2) -> DataFrame:
    """Verdict per left-out key over its evaluable folds."""
    evaluable, good = F.col("folds_evaluables"), F.col("folds_exito_estable")
    verdict = (
        F.when(evaluable < min_folds, "evidencia_insuficiente")
        .when(good == evaluable, "transferencia_sostenida")
        .otherwise("transferencia_no_sostenida")
    )
    return folds.groupBy(key).agg(
        F.count(F.lit(1)).alias("folds_totales"),
        F.count("exito_estable").alias("folds_evaluables"),
        F.count_if(_hit(F.col("exito_estable"))).alias("folds_exito_estable"),
    ).withColumn("veredicto", verdict)


def overall_verdict(keys: DataFrame, few: int = 8, some: int = 11) -> DataFrame:
    """Overall verdict by the number of keys with sustained transfer."""
    sustained = F.col("sostenidos")
    verdict = (
        F.when(sustained <= few, "cerrar_multipais_por_falta_de_transferencia")
        .when(sustained <= some, "inconcluso")
        .otherwise("transferencia_mayoritaria_confirmada")
    )
    return keys.agg(
        F.count_if(F.col("veredicto") == "transferencia_sostenida").alias("sostenidos"),
        F.count(F.lit(1)).alias("evaluados"),
    ).withColumn("veredicto", verdict)


def compare_variants(stable: DataFrame, fold: Sequence[str], base: str, rich: str, by: Sequence[str] = (), gain: float = 0.05) -> DataFrame:
    """Whether the richer variant is justified over all evaluable folds.

    It is when it succeeds in a fold where the base one does not, or when in every
    fold its worst F1 exceeds the base's best by ``gain`` without losing recall.
    A fold is evaluable when both variants are in all seeds; others count nowhere.
    ``stable`` is a stability table with ``variante``.
    """
    pick = lambda name, column: F.max(F.when(F.col("variante") == name, F.col(column)))
    sides = stable.groupBy(*by, *fold).agg(
        pick(rich, "exito_estable").alias("exito_rica"),
        pick(base, "exito_estable").alias("exito_base"),
        pick(rich, "f1_min").alias("f1_rica"),
        pick(base, "f1_max").alias("f1_base"),
        pick(rich, "recall_min").alias("recall_rica"),
        pick(base, "recall_max").alias("recall_base"),
    )
    evaluable = F.col("exito_rica").isNotNull() & F.col("exito_base").isNotNull()
    wins = _hit(F.col("exito_rica") & ~F.col("exito_base"))
    better = _hit(
        (F.col("f1_rica") >= F.col("f1_base") + gain) & (F.col("recall_rica") >= F.col("recall_base"))
    )
    folds, good = F.count_if(evaluable), lambda name: F.count_if(evaluable & F.col(name))
    return sides.groupBy(*by).agg(
        folds.alias("folds"),
        good("exito_base").alias("exitos_base"),
        good("exito_rica").alias("exitos_rica"),
        ((folds > 0) & (good("exito_base") == folds)).alias("base_en_todos"),
        ((folds > 0) & (good("exito_rica") == folds)).alias("rica_en_todos"),
        ((folds > 0) & (F.bool_or(evaluable & wins) | F.bool_and(~evaluable | better))).alias("clima_justificado"),
    )

"""Leak-free train/test folds, their class counts, states and signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekwatch.functions.classify import CLASSES
from weekwatch.operators import contracts

TEST, TRAIN = "prueba", "entrenamiento"


def _years(values: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(y)) for y in values]))


def _eligible(year: Column, targets: Sequence[int], excluded: Sequence[int]) -> Column:
    keep = year.isin(*targets)
    return keep & ~year.isin(*excluded) if excluded else keep


def forward_chaining(rows: DataFrame, external: Sequence[int], targets: Sequence[int], excluded: Sequence[int] = ()) -> DataFrame:
    """Each row once per fold it belongs to: test in its own year, train in later folds.

    The number of folds is the number of external years, fixed by the experiment.
    """
    year, fold = F.col("anio"), F.col("anio_externo")
    role = F.when(year == fold, TEST).when((year < fold) & _eligible(year, targets, excluded), TRAIN)
    return rows.withColumn("anio_externo", _years(external)).withColumn("rol", role).filter(F.col("rol").isNotNull())


def leave_year_out(rows: DataFrame, years: Sequence[int]) -> DataFrame:
    """Retrospective split: every other year trains, later years included."""
    role = F.when(F.col("anio") == F.col("anio_externo"), TEST).otherwise(TRAIN)
    return rows.withColumn("anio_externo", _years(years)).withColumn("rol", role)


def key_out_fold(
    rows: DataFrame, key: str, left_out, external: int, targets: Sequence[int], excluded: Sequence[int] = ()
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold that leaves out a key and looks only at earlier years."""
    year = F.col("anio")
    train = rows.filter((F.col(key) != left_out) & (year < external) & _eligible(year, targets, excluded))
    return train, rows.filter((F.col(key) == left_out) & (year == external))


def key_out_forward(
    rows: DataFrame, key: str, external: Sequence[int], targets: Sequence[int], excluded: Sequence[int] = (), out: str = "clave_externa"
) -> DataFrame:
    """Each row once per (left-out key, external year) fold it belongs to: test in the fold of its own key and year,
    train in those of other keys and later years. The keys are the catalogue of the rows; they bound the copies."""
    year, fold = F.col("anio"), F.col("anio_externo")
    catalogue = rows.agg(F.array_sort(F.collect_set(key))).scalar()
    spread = rows.withColumn("anio_externo", _years(external)).withColumn(
        "rol", F.when(year == fold, TEST).when((year < fold) & _eligible(year, targets, excluded), TRAIN)).filter("rol IS NOT NULL")
    own = F.array(F.col(key))
    return spread.withColumn(out, F.explode(F.when(F.col("rol") == TEST, own).otherwise(F.array_except(catalogue, own))))


def _counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col("etiqueta") == c).alias(c) for c in CLASSES])


def _key_out_counts(rows: DataFrame, key: str, external: Sequence[int], trains: Column) -> DataFrame:
    """Class counts of all key-out folds.

    What a fold trains on is everything eligible minus the left-out key's own
    share, so rows are counted once per (key, year) and never copied per fold.
    """
    small = _counts(rows, [key, "anio"]).withColumn("anio_externo", _years(external))
    is_test = F.col("anio") == F.col("anio_externo")
    spread = small.groupBy(key, "anio_externo").agg(
        *[F.sum(F.when(trains, F.col(c)).otherwise(0)).alias(f"_propio_{c}") for c in CLASSES],
        *[F.sum(F.when(is_test, F.col(c)).otherwise(0)).alias(f"prueba_{c}") for c in CLASSES],
    )
    totals = spread.groupBy("anio_externo").agg(*[F.sum(f"_propio_{c}").alias(f"_todo_{c}") for c in CLASSES])
    return spread.join(F.broadcast(totals), "anio_externo").select(
        key,
        "anio_externo",
        *[(F.col(f"_todo_{c}") - F.col(f"_propio_{c}")).alias(f"entrena_{c}") for c in CLASSES],
        *[f"prueba_{c}" for c in CLASSES],
    )


def key_out_counts(rows: DataFrame, key: str, external: Sequence[int], targets: Sequence[int], excluded: Sequence[int] = ()) -> DataFrame:
    """Counts of every (left-out key, external year) fold that trains on earlier years of the other keys."""
    trains = (F.col("anio") < F.col("anio_externo")) & _eligible(F.col("anio"), targets, excluded)
    return _key_out_counts(rows, key, external, trains)


def key_against_rest_counts(rows: DataFrame, key: str, years: Sequence[int]) -> DataFrame:
    """Counts of the folds that test one key-year and train on all years of the other keys."""
    return _key_out_counts(rows, key, years, F.lit(True))


def fold_counts(assigned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Class counts per fold of rows that carry anio_externo and rol."""
    parts = [
        F.count_if((F.col("rol") == role) & (F.col("etiqueta") == c)).alias(f"{prefix}_{c}")
        for role, prefix in ((TRAIN, "entrena"), (TEST, "prueba"))
        for c in CLASSES
    ]
    return assigned.groupBy(*keys, "anio_externo").agg(*parts)


def _sum(prefix: str) -> Column:
    return sum((F.col(f"{prefix}_{c}") for c in CLASSES[1:]), F.col(f"{prefix}_{CLASSES[0]}"))


def with_state(counts: DataFrame) -> DataFrame:
    """Add fold sizes, state and the mark of folds whose high-class recall is undefined."""
    present = sum((F.when(F.col(f"entrena_{c}") > 0, 1).otherwise(0) for c in CLASSES[1:]),
                  F.when(F.col(f"entrena_{CLASSES[0]}") > 0, 1).otherwise(0))
    state = (
        F.when(F.col("n_prueba") == 0, "sin_test")
        .when(present < 2, "no_entrenable")
        .when(present < len(CLASSES), "entrenable_con_clase_ausente")
        .otherwise("entrenable")
    )
    mark = F.when((F.col("n_prueba") > 0) & (F.col("prueba_alto") == 0), "recall_alto_no_evaluable").otherwise("")
    return counts.withColumns({"n_entrena": _sum("entrena"), "n_prueba": _sum("prueba")}).withColumns(
        {"estado": state, "marca": mark}
    )


def _distribution(prefix: str) -> Column:
    parts = [F.format_string(f'"{c}":%d', f"{prefix}_{c}") for c in sorted(CLASSES)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fold_text(key: str) -> Column:
    """Canonical JSON of one fold: sorted keys, no spaces."""
    mark = F.when(F.col("marca") == "", "").otherwise(F.concat(F.lit('"'), "marca", F.lit('"')))
    return F.concat(
        F.lit('{"anio_externo":'), F.col("anio_externo").cast("string"),
        F.lit(',"distribucion_test":'), _distribution("prueba"),
        F.lit(',"distribucion_train":'), _distribution("entrena"),
        F.lit(',"estado":"'), F.col("estado"),
        F.lit('","marcas":['), mark,
        F.lit('],"n_test":'), F.col("n_prueba").cast("string"),
        F.lit(',"n_train":'), F.col("n_entrena").cast("string"),
        F.lit(',"pais_externo":"'), F.col(key).cast("string"), F.lit('"}'),
    )


def fold_signatures(folds: DataFrame, key: str) -> DataFrame:
    """SHA-256 per left-out key over its folds in year order; compare with the frozen one."""
    texts = folds.select(key, F.struct("anio_externo", fold_text(key).alias("t")).alias("f"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["t"]), ",")
    return texts.groupBy(key).agg(F.concat(F.lit('{"folds":['), joined, F.lit("]}")).alias("firma")).select(
        key, F.sha2(F.encode("firma", "UTF-8"), 256).alias("firma_sha256")
    )


SIGNATURE_FIELDS = (
    "estado", "marca", "n_entrena", "n_prueba", *(f"{part}_{c}" for part in ("entrena", "prueba") for c in CLASSES))


def signature_difference(observed: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """Where two tables of folds with state differ: key, external year, field, expected and observed value.

    A fold that only one of them has is a difference of the field ``fold``.
    """
    on = [key, "anio_externo"]
    fields = ["fold", *SIGNATURE_FIELDS]

    def texts(folds: DataFrame, name: str) -> DataFrame:
        values = [F.lit("presente"), *[F.col(f).cast("string") for f in SIGNATURE_FIELDS]]
        return folds.select(*on, F.array(*values).alias(name))

    both = texts(frozen, "esperado").join(texts(observed, "observado"), on, "full")
    each = both.select(*on, F.posexplode(F.arrays_zip(
        F.coalesce("esperado", F.array_repeat(F.lit("ausente"), len(fields))).alias("esperado"),
        F.coalesce("observado", F.array_repeat(F.lit("ausente"), len(fields))).alias("observado"))).alias("_i", "_v"),
        (F.col("esperado").isNotNull() & F.col("observado").isNotNull()).alias("_ambos"))
    different = ~F.col("_v.esperado").eqNullSafe(F.col("_v.observado")) & (F.col("_ambos") | (F.col("_i") == 0))
    return each.filter(different).select(
        *on, F.get(F.array(*[F.lit(f) for f in fields]), F.col("_i")).alias("campo"), F.col("_v.esperado").alias("esperado"), F.col("_v.observado").alias("observado"))


def require_signature(observed: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """The observed folds; the job aborts with the fold and field that differ from the frozen ones."""
    wrong = signature_difference(observed, frozen, key)
    return contracts.without(observed, wrong, contracts.named("folds differ from the frozen ones", wrong.columns))


def class_weights(assigned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Balanced weight n / (classes x n_class) of each class present in a fold's training rows."""
    train = assigned.filter(F.col("rol") == TRAIN)
    counts = train.groupBy(*keys, "anio_externo", "etiqueta").agg(F.count(F.lit(1)).alias("n"))
    fold = Window.partitionBy(*keys, "anio_externo")
    return counts.withColumn("peso", F.sum("n").over(fold) / (F.count(F.lit(1)).over(fold) * F.col("n")))


def _rank_key(preferred: Column) -> Column:
    """Order of a class in a mode: count, preferred class, then the fixed class order."""
    place = F.when(F.col("etiqueta") == CLASSES[0], 0).when(F.col("etiqueta") == CLASSES[1], 1).otherwise(2)
    return F.struct("n", F.coalesce(F.col("etiqueta") == preferred, F.lit(False)).alias("preferida"), (-place).alias("orden"))


def modes(counts: DataFrame, by: Sequence[str], preferred: Column | None = None) -> DataFrame:
    """Most frequent class per group. ``counts`` has (by, etiqueta, n)."""
    choice = preferred if preferred is not None else F.lit(None).cast("string")
    return counts.groupBy(*by).agg(F.max_by("etiqueta", _rank_key(choice)).alias("moda"))


def previous_label(labels: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Label of the week before within the same year; null at the start of a year and after a gap.

    Pass all labels to look up weeks that were later discarded, or only the test
    rows to stay within them.
    """
    year = Window.partitionBy(*entity, "anio").orderBy("semana").rangeBetween(-1, -1)
    return labels.withColumn("persistencia", F.max("etiqueta").over(year))


def references(
    assigned: DataFrame, keys: Sequence[str], entity: Sequence[str], all_labels: DataFrame | None = None
) -> DataFrame:
    """Four naive predictions per test row: weekly mode, majority, always high, persistence.

    Persistence looks among the test rows, or in ``all_labels`` when given, which
    also holds the labels of rows that were discarded from the folds.
    """
    fold = [*keys, "anio_externo"]
    train = assigned.filter(F.col("rol") == TRAIN)
    by_week = train.groupBy(*fold, "semana", "etiqueta").agg(F.count(F.lit(1)).alias("n"))
    overall = modes(by_week.groupBy(*fold, "etiqueta").agg(F.sum("n").alias("n")), fold).withColumnRenamed(
        "moda", "constante_mayoritaria"
    )
    with_global = by_week.join(overall, fold)
    weekly = modes(with_global, [*fold, "semana"], F.col("constante_mayoritaria")).withColumnRenamed("moda", "_semanal")
    test = assigned.filter(F.col("rol") == TEST)
    if all_labels is None:
        test = previous_label(test, [*keys, *entity])
    else:
        row = [*keys, *entity, "anio", "semana"]
        before = all_labels.select(
            *keys, *entity, "anio", (F.col("semana") + 1).alias("semana"), F.col("etiqueta").alias("persistencia")
        )
        test = test.join(before, row, "left")
    return (
        test.join(overall, fold)
        .join(weekly, [*fold, "semana"], "left")
        .withColumns(
            {
                "climatologica": F.coalesce("_semanal", "constante_mayoritaria"),
                "siempre_alto": F.lit("alto"),
            }
        )
        .drop("_semanal", "rol")
    )


REFERENCES = ("climatologica", "constante_mayoritaria", "siempre_alto", "persistencia")

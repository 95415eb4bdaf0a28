"""Lagged predictors. Frames are ranges of weeks, so a gap empties them by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from weekwatch.functions import suitability

INDEX = "indice"


def _weeks(keys: Sequence[str], first: int, last: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(INDEX).rangeBetween(-first, -last)


def lag_of(column: str, keys: Sequence[str], weeks: int) -> Column:
    """Value exactly ``weeks`` weeks ago, over year ends; null when that week is missing."""
    return F.max(column).over(_weeks(keys, weeks, weeks))


def trailing_mean(column: str, keys: Sequence[str], weeks: int) -> Column:
    """Mean of the previous ``weeks`` weeks, the current one excluded; null unless all exist."""
    frame = _weeks(keys, weeks, 1)
    return F.when(F.count(column).over(frame) == weeks, F.sum(column).over(frame) / F.lit(float(weeks)))


def lagged(
    weekly: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str],
    lags: Sequence[int] = (1, 2),
    windows: Sequence[int] = (4,),
) -> DataFrame:
    """Lags and trailing means of each variable. ``weekly`` carries the week index in ``indice``."""
    columns = {}
    for v in variables:
        columns |= {f"{v}_lag{k}": lag_of(v, keys, k) for k in lags}
        columns |= {f"{v}_media_movil{w}": trailing_mean(v, keys, w) for w in windows}
    return weekly.withColumns(columns)


def feature_names(variables: Sequence[str], lags: Sequence[int] = (1, 2), windows: Sequence[int] = (4,)) -> list[str]:
    return [
        name
        for v in variables
        for name in [f"{v}_lag{k}" for k in lags] + [f"{v}_media_movil{w}" for w in windows]
    ]


MECHANISTIC = (
    "racha_termica_transmision_8s",
    "grados_dia_desarrollo_4s",
    "semanas_optimas_temp_humedad_4s",
    "interaccion_termohigrometrica_4s",
    "amplitud_termica_media_4s",
    "duracion_lluvia_4s",
    "pulso_seco_humedo_1s",
)


def mechanistic(weekly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seven biological predictors over the previous 8 and 4 weeks; null unless all 8 exist."""
    t, h = F.col("temp_media"), F.col("humedad_relativa_media")
    eight, four = _weeks(keys, 8, 1), _weeks(keys, 4, 1)
    complete = F.count(F.lit(1)).over(eight) == 8

    suitable = F.reverse(F.collect_list(suitability.transmits(t)).over(eight))
    streak = F.aggregate(
        suitable,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("sigue")),
        lambda acc, ok: F.struct(
            (acc["n"] + F.when(acc["sigue"] & ok, 1).otherwise(0)).alias("n"), (acc["sigue"] & ok).alias("sigue")
        ),
        lambda acc: acc["n"].cast("double"),
    )
    older_rain = F.sum("precipitation_sum").over(_weeks(keys, 4, 2)) / 3.0
    values = {
        "racha_termica_transmision_8s": streak,
        "grados_dia_desarrollo_4s": F.sum(suitability.degree_days(t)).over(four),
        "semanas_optimas_temp_humedad_4s": F.sum(suitability.optimum(t, h).cast("double")).over(four),
        "interaccion_termohigrometrica_4s": F.sum(suitability.moist_heat(t, h)).over(four) / 4.0,
        "amplitud_termica_media_4s": F.sum(F.col("temp_max") - F.col("temp_min")).over(four) / 4.0,
        "duracion_lluvia_4s": F.sum("precipitation_hours").over(four),
        "pulso_seco_humedo_1s": F.greatest(lag_of("precipitation_sum", keys, 1) - older_rain, F.lit(0.0)),
    }
    return weekly.withColumns({name: F.when(complete, value) for name, value in values.items()})


def case_lags(series: DataFrame, keys: Sequence[str], excluded: Sequence[int] = ()) -> DataFrame:
    """Case predictors with the reason why a row cannot have them.

    ``motivo`` is set when one of the four previous weeks falls in an excluded
    year or has no count. ``series`` carries ``indice``.
    """
    four = _weeks(keys, 4, 1)
    touches = F.coalesce(F.max(F.col("anio").isin(*excluded)).over(four), F.lit(False))
    missing = F.count("valor").over(four) < 4
    reason = F.when(touches, "rezago_casos_anio_excluido").when(missing, "sin_historia_casos")
    marked = series.withColumns({"motivo": reason, "casos": F.col("valor")})
    return lagged(marked, keys, ["casos"])


def profile(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and distinct values of each predictor."""
    long = features.unpivot([], list(names), "variable", "valor").filter(F.col("valor").isNotNull())
    return long.groupBy("variable").agg(
        F.min("valor").alias("minimo"),
        F.max("valor").alias("maximo"),
        F.avg("valor").alias("media"),
        F.count_distinct("valor").alias("valores_unicos"),
    )


def training_set(
    labels: DataFrame,
    features: DataFrame,
    names: Sequence[str],
    excluded: Sequence[int],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Labelled rows with their predictors and one reason column; null means usable.

    Reasons apply in order: excluded year, insufficient label, incomplete history.
    """
    joined = labels.join(features.select(*keys, "anio", "semana", *names), [*keys, "anio", "semana"], "left")
    incomplete = F.greatest(*[F.col(n).isNull() for n in names]) if len(names) > 1 else F.col(names[0]).isNull()
    reason = (
        F.when(F.col("anio").isin(*excluded), "anio_excluido")
        .when(F.col("etiqueta").isNull(), F.coalesce("motivo", F.lit("sin_etiqueta")))
        .when(incomplete, "sin_historia_climatica")
    )
    return joined.withColumn("motivo", reason)


def usable_rows(rows: DataFrame, reasons: Sequence[str], seen: Observation | None = None) -> DataFrame:
    """Rows of ``training_set`` that can be used.

    ``seen`` receives from the job that writes them how many rows there were, stay, and were discarded for each reason.
    """
    if seen is not None:
        rows = rows.observe(
            seen, F.count(F.lit(1)).alias("candidatas"), F.count_if(F.col("motivo").isNull()).alias("filas_finales"),
            *[F.count_if(F.col("motivo") == r).alias(r) for r in reasons])
    return rows.filter(F.col("motivo").isNull()).drop("motivo")


def discard_counts(rows: DataFrame, kept: str = "filas_finales") -> DataFrame:
    """Rows per reason; usable rows are counted under ``kept``."""
    return rows.groupBy(F.coalesce("motivo", F.lit(kept)).alias("motivo")).agg(F.count(F.lit(1)).alias("filas"))

"""Endemic channels and the labels derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.classify import CLASSES, ZONE_TO_CLASS, ZONES, by_map, four_zones, two_cuts
from weekwatch.functions.percentiles import linear_percentile, sorted_values
from weekwatch.operators import pools

INSUFFICIENT = "sin_suficiencia_etiqueta"


def endemic_channel(
    series: DataFrame,
    keys: Sequence[str],
    base_years: Sequence[int],
    window: int = 1,
    min_obs: int = 12,
    min_years: int = 3,
) -> DataFrame:
    """Leave-one-out channel with both three-class schemes and the four zones.

    Described years are the base years.
    """
    cells = pools.observed_cells(
        series.filter(F.col("anio").isin(*base_years)), keys, pools.others_in(base_years), window
    )
    cells = pools.percentiles(cells, p25=0.25, p50=0.50, p75=0.75, p90=0.90)
    value = F.col("valor")
    return cells.select(
        *keys,
        "anio",
        "semana",
        "valor",
        "n_obs",
        "anios_presentes",
        pools.sufficient(min_obs, min_years).alias("suficiente"),
        "p25",
        "p50",
        "p75",
        "p90",
        two_cuts(value, F.col("p75"), F.col("p90")).alias("clase_p75_p90"),
        two_cuts(value, F.col("p50"), F.col("p75")).alias("clase_p50_p75"),
        four_zones(value, F.col("p25"), F.col("p50"), F.col("p75")).alias("zona"),
    )


def with_zone_class(channel: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Zone collapsed to a class by an explicit map."""
    return channel.withColumn("clase_colapsada", by_map(F.col("zona"), mapping or ZONE_TO_CLASS))


def scheme_disagreements(channel: DataFrame) -> DataFrame:
    """Sufficient cells whose collapsed zone differs from the P50/P75 class; must be empty."""
    return with_zone_class(channel).filter(
        F.col("suficiente") & (F.col("clase_colapsada") != F.col("clase_p50_p75"))
    )


def retrospective_labels(
    series: DataFrame,
    keys: Sequence[str],
    base_years: Sequence[int],
    cuts: tuple[float, float] = (0.75, 0.90),
    window: int = 1,
    min_obs: int = 12,
    min_years: int = 3,
) -> DataFrame:
    """Label against all other base years, later ones included; insufficient cells are kept unlabelled."""
    cells = pools.observed_cells(
        series.filter(F.col("anio").isin(*base_years)), keys, pools.others_in(base_years), window
    )
    return _labelled(cells, keys, cuts, min_obs, min_years)


def prospective_labels(
    series: DataFrame,
    keys: Sequence[str],
    excluded: Sequence[int] = (),
    first_year: int | None = None,
    cuts: tuple[float, float] = (0.75, 0.90),
    window: int = 1,
    min_obs: int = 12,
    min_years: int = 3,
) -> DataFrame:
    """Label against earlier years only. Never reads the labelled year or a later one."""
    cells = pools.observed_cells(series, keys, pools.earlier_than(excluded, first_year), window)
    return _labelled(cells, keys, cuts, min_obs, min_years)


def _labelled(cells: DataFrame, keys: Sequence[str], cuts, min_obs: int, min_years: int) -> DataFrame:
    enough = pools.sufficient(min_obs, min_years)
    cells = cells.withColumns(
        {
            "corte_inferior": F.when(enough, linear_percentile(F.col("pool"), cuts[0])),
            "corte_superior": F.when(enough, linear_percentile(F.col("pool"), cuts[1])),
        }
    )
    return cells.select(
        *keys,
        "anio",
        "semana",
        "valor",
        "n_obs",
        "anios_presentes",
        "corte_inferior",
        "corte_superior",
        two_cuts(F.col("valor"), F.col("corte_inferior"), F.col("corte_superior")).alias("etiqueta"),
        F.when(~enough, INSUFFICIENT).alias("motivo"),
        "claves",
    )


def within_year_labels(
    series: DataFrame,
    keys: Sequence[str],
    cuts: tuple[float, float] = (0.50, 0.75),
    required_weeks: int | None = 52,
) -> DataFrame:
    """Label of a week among the weeks of its own year.

    Years without exactly ``required_weeks`` weeks are left out (None keeps all).
    """
    years = series.groupBy(*keys, "anio").agg(
        F.collect_list(F.struct("semana", F.col("valor").cast("double").alias("valor"))).alias("filas")
    )
    if required_weeks is not None:
        years = years.filter(F.size("filas") == required_weeks)
    ordered = years.withColumn("pool", sorted_values(F.col("filas"), lambda v: F.lit(True)))
    cut = ordered.withColumns(
        {
            "corte_inferior": linear_percentile(F.col("pool"), cuts[0]),
            "corte_superior": linear_percentile(F.col("pool"), cuts[1]),
        }
    )
    return cut.select(
        *keys, "anio", F.inline("filas"), "corte_inferior", "corte_superior"
    ).withColumn("etiqueta", two_cuts(F.col("valor"), F.col("corte_inferior"), F.col("corte_superior")))


def unpaired_labels(
    series: DataFrame,
    keys: Sequence[str],
    base_years: Sequence[int],
    cuts: tuple[float, float] = (0.75, 0.90),
) -> DataFrame:
    """Label against all weeks of the other base years, whatever their season.

    One history per key: at most base years x 53 values.
    """
    rows = series.filter(F.col("anio").isin(*base_years)).select(
        *keys, F.struct("anio", "semana", F.col("valor").cast("double").alias("valor")).alias("v")
    )
    histories = rows.groupBy(*keys).agg(F.collect_list("v").alias("todas"))
    years = histories.withColumn(
        "anio", F.explode(F.array_distinct(F.transform("todas", lambda v: v["anio"])))
    )
    pooled = years.withColumn("pool", sorted_values(F.col("todas"), lambda v: v["anio"] != F.col("anio")))
    cut = pooled.withColumns(
        {
            "corte_inferior": linear_percentile(F.col("pool"), cuts[0]),
            "corte_superior": linear_percentile(F.col("pool"), cuts[1]),
            "propias": F.filter("todas", lambda v: v["anio"] == F.col("anio")),
        }
    )
    return cut.select(*keys, F.inline("propias"), "corte_inferior", "corte_superior").withColumn(
        "etiqueta", two_cuts(F.col("valor"), F.col("corte_inferior"), F.col("corte_superior"))
    )


def class_distribution(labels: DataFrame, by: Sequence[str], column: str = "etiqueta") -> DataFrame:
    """Zero-filled counts per class and their total; one map-side combined aggregate."""
    counts = [
        F.count_if(F.coalesce(F.col(column) == name, F.lit(False))).alias(name) for name in CLASSES
    ]
    total = sum((F.col(name) for name in CLASSES[1:]), F.col(CLASSES[0]))
    return labels.groupBy(*by).agg(*counts).withColumn("total", total)


def zone_distribution(channel: DataFrame, by: Sequence[str]) -> DataFrame:
    sure = channel.filter("suficiente")
    counts = [F.count_if(F.col("zona") == zone).alias(zone) for zone in ZONES]
    return sure.groupBy(*by).agg(*counts).withColumn("total", sum((F.col(z) for z in ZONES[1:]), F.col(ZONES[0])))


def same_week_summary(channel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells of ``same_week_channel``, those whose upper quartile is 0 and their share, and those under the floors."""
    zero = F.count_if(F.col("p75") == 0)
    return channel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("celdas"), zero.alias("q3_cero"), (zero / F.count(F.lit(1))).alias("fraccion_q3_cero"),
        F.count_if(~F.col("suficiente")).alias("bajo_piso"))


def same_week_channel(points: DataFrame, keys: Sequence[str], base_years: Sequence[int], min_obs: int = 12, min_years: int = 3) -> DataFrame:
    """Quartiles per key, week 1..52 and described year, without neighbour weeks.

    The full grid is kept, empty cells included. The pool of a cell holds one
    value per other year, so ``min_obs`` of 12 is never reached with few years.
    """
    seen = points.filter(F.col("valor").isNotNull() & F.col("anio").isin(*base_years))
    cells = pools.neighbourhoods(seen, keys, window=0)
    grid = (
        points.select(*keys).distinct().withColumn("semana", F.explode(F.sequence(F.lit(1), F.lit(52))))
    )
    years = F.explode(F.array(*[F.lit(y) for y in base_years]))
    full = (
        grid.join(cells, [*keys, "semana"], "left")
        .withColumn("vecinas", F.coalesce("vecinas", F.expr("array()").cast(cells.schema["vecinas"].dataType)))
        .withColumn("anio_objetivo", years)
    )
    pooled = pools.with_pool(full, F.col("anio_objetivo"), lambda year, target: year != target)
    pooled = pools.percentiles(pooled, p25=0.25, p50=0.50, p75=0.75)
    return pooled.select(
        *keys,
        "semana",
        "anio_objetivo",
        "n_obs",
        "anios_presentes",
        pools.sufficient(min_obs, min_years).alias("suficiente"),
        "p25",
        "p50",
        "p75",
    )

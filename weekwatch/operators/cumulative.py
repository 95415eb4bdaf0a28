"""From cumulative counters since week 1 to weekly values.

A week is never invented: gaps and downward corrections become nulls with a
note, and are neither interpolated nor clamped to zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Note texts of the stored series.
NOTE_GAP = "hueco entre cortes SE%d y SE%d -- sin dato semanal"
NOTE_CORRECTION = "correccion retroactiva: diff=%d (excluida de la serie)"
NOTE_FIRST = "primer corte del anio en SE%d: acumulado SE1-SE%d, no incidencia de una semana"
NOTE_VERSION = "version %d superada por version %d"


def resolve_versions(files: DataFrame) -> DataFrame:
    """Mark the file that stands for its (anio, semana_archivo) and note the ones it replaces.

    Files without a week never collide. Among equal versions the last name wins.
    """
    key = F.coalesce("semana_archivo", "archivo")
    keyed = files.withColumn("_clave", key)
    best = keyed.groupBy("anio", "_clave").agg(
        F.max(F.struct("version", "archivo")).alias("_mejor")
    )
    note = F.format_string(NOTE_VERSION, F.col("version"), F.col("_mejor.version"))
    current = F.col("archivo") == F.col("_mejor.archivo")
    return keyed.join(best, ["anio", "_clave"]).withColumns(
        {"vigente": current, "nota": F.when(~current, note)}
    ).drop("_clave", "_mejor")


def last_cut_wins(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One counter per key and cut week: the value of the last file, with that file as origin."""
    return cuts.groupBy(*keys, "anio", "semana").agg(
        F.max_by("acum", "archivo").alias("acum"), F.max("archivo").alias("archivo")
    )


def _with_previous(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    year = Window.partitionBy(*keys, "anio").orderBy("semana")
    return cuts.withColumns(
        {"previa": F.lag("semana").over(year), "antes": F.lag("acum").over(year)}
    )


def deaccumulate(cuts: DataFrame, keys: Sequence[str], mark_first: bool = True) -> DataFrame:
    """Weekly points (keys, anio, semana, valor, nota, tipo) of counters with unique cut weeks.

    ``tipo`` is valor, primer_corte, hueco or correccion. The gap test comes
    before the sign test. ``mark_first`` notes a first cut that spans several weeks.
    """
    gap = F.col("semana") - F.col("previa") > 1
    diff = F.col("acum") - F.col("antes")
    first = F.col("previa").isNull()
    spans = first & (F.col("semana") > 1) & F.lit(mark_first)
    kind = (
        F.when(spans, "primer_corte")
        .when(first, "valor")
        .when(gap, "hueco")
        .when(diff < 0, "correccion")
        .otherwise("valor")
    )
    value = F.when(first, F.col("acum")).when(~gap & (diff >= 0), diff)
    note = (
        F.when(F.col("tipo") == "primer_corte", F.format_string(NOTE_FIRST, "semana", "semana"))
        .when(F.col("tipo") == "hueco", F.format_string(NOTE_GAP, "previa", "semana"))
        .when(F.col("tipo") == "correccion", F.format_string(NOTE_CORRECTION, F.bround(diff, 0).cast("bigint")))
        .otherwise("")
    )
    weeks = F.when(gap, F.sequence(F.col("previa") + 1, F.col("semana"))).otherwise(F.array("semana"))
    return (
        _with_previous(cuts, keys)
        .withColumn("tipo", kind)
        .withColumns({"valor": value.cast("double"), "nota": note, "semanas": weeks})
        .select(*keys, "anio", F.explode("semanas").alias("semana"), "valor", "nota", "tipo")
    )


def corrections(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consecutive cuts whose counter went down, with both counters."""
    step = F.col("acum") - F.col("antes")
    return (
        _with_previous(cuts, keys)
        .filter((F.col("semana") - F.col("previa") == 1) & (step < 0))
        .select(
            *keys,
            "anio",
            "semana",
            step.alias("diferencia"),
            F.col("antes").alias("acumulado_anterior"),
            F.col("acum").alias("acumulado_actual"),
        )
    )


def monotonicity(cuts: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rising, equal and falling pairs of consecutive cuts."""
    step = F.col("acum") - F.col("antes")
    return (
        _with_previous(cuts, keys)
        .filter(F.col("previa").isNotNull())
        .groupBy(*by)
        .agg(
            F.count_if(step > 0).alias("crecientes"),
            F.count_if(step == 0).alias("iguales"),
            F.count_if(step < 0).alias("decrecientes"),
        )
    )


def reprints(cuts: DataFrame, keys: Sequence[str] = (), bulletin: Sequence[str] = ()) -> DataFrame:
    """Bulletins whose region values all equal those of the previous cut of the year: (keys, anio, semana, previa).

    A bulletin is a cut week, or a cut week and the columns ``bulletin`` where a week has several; those come in their
    order and the result has them, as ``previa_<column>`` too. Tables are compared by a digest that does not depend on the
    order of the rows; where it is equal, the rows are compared themselves, by a join. No bulletin is ever collected
    into one row.
    """
    own = [*keys, "anio", "semana", *bulletin]
    row = F.xxhash64("region", "acum")
    tables = cuts.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), F.struct(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(2**31)))).alias("_huella")
    )
    year = Window.partitionBy(*keys, "anio").orderBy("semana", *bulletin)
    before = {f"previa{'_' + c if c != 'semana' else ''}": F.lag(c).over(year) for c in ("semana", *bulletin)}
    alike = tables.withColumns({**before, "_antes": F.lag("_huella").over(year)}).filter("_huella = _antes").drop("_huella", "_antes")
    rows = cuts.select(*own, "region", "acum").join(alike, own)
    older = cuts.select(*keys, "anio", *[F.col(c).alias(b) for b, c in zip(before, ("semana", *bulletin))], "region", F.col("acum").alias("antes"))
    same = rows.join(older, [*keys, "anio", *before, "region"]).filter(F.col("acum").eqNullSafe(F.col("antes")))
    return (
        same.groupBy(*own, *before, "n")
        .agg(F.count(F.lit(1)).alias("iguales"))
        .filter(F.col("iguales") == F.col("n"))
        .select(*own, *before)
    )


def safe_points(points: DataFrame) -> DataFrame:
    """Points without a note; the others never become facts."""
    return points.filter(F.trim("nota") == "")


def with_origin(points: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with the file that supplied their cut; weeks inside a gap have none."""
    origin = cuts.select(*keys, "anio", "semana", "archivo")
    return points.join(origin, [*keys, "anio", "semana"], "left")


def case_rows(points: DataFrame) -> DataFrame:
    """Fact rows of the points that have a value, rounded half-even to whole cases."""
    known = points.filter(F.col("valor").isNotNull())
    return known.withColumn("conteo", F.bround("valor", 0).cast("int")).drop("valor", "nota", "tipo")


def load_counters(points: DataFrame) -> DataFrame:
    """One row: inserted points, omitted gap weeks and omitted corrections."""
    return points.agg(
        F.count("valor").alias("insertadas"),
        F.count_if(F.col("tipo") == "hueco").alias("huecos_omitidos"),
        F.count_if(F.col("tipo") == "correccion").alias("correcciones_omitidas"),
    )


def yearly_distribution(points: DataFrame, keys: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Per key and year: weeks with data, registered weeks, total, median, maximum and share of zeros.

    Every key appears for every year, also without data.
    """
    grid = points.select(*keys).distinct().withColumn("anio", F.explode(F.array(*[F.lit(y) for y in years])))
    value = F.col("valor")
    stats = points.groupBy(*keys, "anio").agg(
        F.count(value).alias("semanas_con_dato"),
        F.count(F.lit(1)).alias("semanas_registradas"),
        F.sum(value).alias("total_anual"),
        F.median(value).alias("mediana_semanal"),
        F.max(value).alias("maximo_semanal"),
        (F.count_if(value == 0) / F.nullif(F.count(value), F.lit(0))).alias("fraccion_cero"),
    )
    return grid.join(stats, [*keys, "anio"], "left").fillna(0, ["semanas_con_dato", "semanas_registradas"])


def loss_audit(points: DataFrame, channel: DataFrame, keys: Sequence[str], years: Sequence[int], limit: float = 0.20) -> DataFrame:
    """Per key: share of weeks without data, whether it exceeds ``limit``, and years without any high week.

    ``channel`` holds (keys, semana, anio, n_obs, p75); a week is high above the
    P75 of at least two other years.
    """
    judged = points.join(channel, [*keys, "anio", "semana"], "left")
    high = (F.col("n_obs") >= 2) & (F.col("valor") > F.col("p75"))
    expected = F.array(*[F.lit(y) for y in years])
    return (
        judged.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("semanas_registradas"),
            F.count_if(F.col("valor").isNull()).alias("semanas_sin_dato"),
            F.array_intersect(F.collect_set(F.when(high, F.col("anio"))), expected).alias("_con"),
        )
        .select(
            *keys,
            "semanas_registradas",
            "semanas_sin_dato",
            (F.col("semanas_sin_dato") / F.col("semanas_registradas")).alias("fraccion_perdida"),
            (F.col("semanas_sin_dato") / F.col("semanas_registradas") > limit).alias("pierde_mas_20"),
            F.size("_con").cast("bigint").alias("anios_con_alta"),
            F.array_join(F.array_sort(F.array_except(expected, F.col("_con"))).cast("array<string>"), ",").alias(
                "anios_sin_alta"
            ),
        )
    )


def nested_series(points: DataFrame, key: str) -> DataFrame:
    """Per key: JSON of year -> [[week, value, note?], ...] in week order."""
    whole = F.col("valor").cast("bigint").cast("string")
    parts = F.when(F.col("nota") == "", F.array(F.col("semana").cast("string"), F.coalesce(whole, F.lit("null")))).otherwise(
        F.array(F.col("semana").cast("string"), F.coalesce(whole, F.lit("null")), _quoted(F.col("nota")))
    )
    point = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    years = points.groupBy(key, "anio").agg(F.array_sort(F.collect_list(F.struct("semana", point.alias("p")))).alias("filas"))
    texts = F.concat(
        F.lit('"'), F.col("anio").cast("string"), F.lit('":['), F.array_join(F.col("filas.p"), ","), F.lit("]")
    )
    return years.groupBy(key).agg(
        F.concat(
            F.lit("{"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("anio", texts.alias("t")))), lambda y: y["t"]), ","),
            F.lit("}"),
        ).alias("series")
    )


def nested_states(documents: DataFrame) -> DataFrame:
    """Per year: JSON of state -> number of documents, states in order."""
    counts = documents.groupBy("anio", "estado").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("anio").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("estado", "n"))))).alias("estados"))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def missing_weeks(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weeks without data per key and year."""
    return points.groupBy(*keys, "anio").agg(F.count_if(F.col("valor").isNull()).alias("semanas_sin_dato"))

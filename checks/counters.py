"""Cumulative-counter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BASE_YEARS, check, pct, view
from weekwatch.operators import channel, cumulative, summary
from weekwatch.plans import adapters as A

KEYS = ["clase", "region"]

view("archivos", "SELECT DISTINCT archivo, anio, semana, version FROM cuts")
view("vigentes", "SELECT c.* FROM cuts c JOIN (SELECT anio, semana, max(version) AS version FROM cuts GROUP BY ALL) USING (anio, semana, version)")
view(
    "pasos",
    """SELECT *, lag(semana) OVER w AS previa, lag(acum) OVER w AS antes FROM vigentes
    WINDOW w AS (PARTITION BY clase, region, anio ORDER BY semana)""",
)
view(
    "puntos",
    """SELECT clase, region, anio, CAST(unnest(CASE WHEN tipo = 'hueco' THEN generate_series(previa + 1, semana) ELSE [semana] END) AS INTEGER) AS semana,
        CAST(CASE WHEN previa IS NULL THEN acum WHEN tipo = 'valor' THEN acum - antes END AS DOUBLE) AS valor,
        CASE tipo WHEN 'primer_corte' THEN 'primer corte del anio en SE' || semana || ': acumulado SE1-SE' || semana || ', no incidencia de una semana'
            WHEN 'hueco' THEN 'hueco entre cortes SE' || previa || ' y SE' || semana || ' -- sin dato semanal'
            WHEN 'correccion' THEN 'correccion retroactiva: diff=' || (acum - antes) || ' (excluida de la serie)' ELSE '' END AS nota, tipo
    FROM (SELECT *, CASE WHEN previa IS NULL AND semana > 1 THEN 'primer_corte' WHEN previa IS NULL THEN 'valor'
            WHEN semana - previa > 1 THEN 'hueco' WHEN acum < antes THEN 'correccion' ELSE 'valor' END AS tipo FROM pasos)""",
)


def files(spark, d):
    from weekwatch.functions.text import file_version, file_week

    names = A.cuts(spark, d).select("archivo", "anio").distinct()
    return names.withColumns(
        {"semana_archivo": file_week(F.col("archivo")), "version": file_version(F.col("archivo"))}
    )


def current_cuts(spark, d):
    """Counters of the files that stand, one per key and week."""
    cuts = A.cuts(spark, d)
    best = F.max("version").alias("version")
    standing = cuts.groupBy("anio", "semana").agg(best)
    kept = cuts.join(standing, ["anio", "semana", "version"])
    return cumulative.last_cut_wins(kept, KEYS)


def points(spark, d):
    return cumulative.deaccumulate(current_cuts(spark, d), KEYS)


@check(
    "X6_file_name_parts",
    """SELECT archivo, anio, lpad(CAST(semana AS VARCHAR), 2, '0') AS semana_archivo, version FROM archivos""",
)
def x6(spark, d):
    return files(spark, d)


@check(
    "W8_version_resolution",
    """SELECT archivo, anio, version, version = mejor AS vigente,
        CASE WHEN version < mejor THEN 'version ' || version || ' superada por version ' || mejor END AS nota
    FROM (SELECT *, max(version) OVER (PARTITION BY anio, semana) AS mejor FROM archivos)""",
)
def w8(spark, d):
    return cumulative.resolve_versions(files(spark, d)).select("archivo", "anio", "version", "vigente", "nota")


@check(
    "W9_last_cut_wins",
    "SELECT clase, region, anio, semana, arg_max(acum, archivo) AS acum, max(archivo) AS archivo FROM cuts GROUP BY ALL",
)
def w9(spark, d):
    return cumulative.last_cut_wins(A.cuts(spark, d), KEYS)


@check("W4_deaccumulated_points", "SELECT * FROM puntos")
def w4(spark, d):
    return points(spark, d)


@check("W5_gap_weeks", "SELECT clase, region, anio, semana, nota FROM puntos WHERE tipo = 'hueco'")
def w5(spark, d):
    return points(spark, d).filter("tipo = 'hueco'").select(*KEYS, "anio", "semana", "nota")


@check(
    "W6_negative_corrections",
    """SELECT clase, region, anio, semana, acum - antes AS diferencia, antes AS acumulado_anterior, acum AS acumulado_actual
    FROM pasos WHERE semana - previa = 1 AND acum < antes""",
)
def w6(spark, d):
    return cumulative.corrections(current_cuts(spark, d), KEYS)


@check(
    "W7_first_cut_marker",
    """SELECT clase, region, anio, semana, valor, nota FROM puntos WHERE tipo = 'primer_corte'
    UNION ALL SELECT clase, region, anio, semana, valor, nota FROM (
        SELECT clase, region, anio, semana, acum::DOUBLE AS valor,
            'primer corte del anio en SE' || semana || ': acumulado SE1-SE' || semana || ', no incidencia de una semana' AS nota
        FROM vigentes WHERE semana > 1 QUALIFY row_number() OVER (PARTITION BY clase, region, anio ORDER BY semana) = 1)""",
)
def w7(spark, d):
    cuts = current_cuts(spark, d)
    late = cumulative.deaccumulate(cuts.filter(F.col("semana") > 1), KEYS)
    return (
        cumulative.deaccumulate(cuts, KEYS)
        .unionByName(late)
        .filter("tipo = 'primer_corte'")
        .select(*KEYS, "anio", "semana", "valor", "nota")
    )


@check(
    "W10_reprinted_bulletins",
    """WITH b AS (SELECT clase, anio, semana, list(region || ':' || acum ORDER BY region) AS v FROM vigentes GROUP BY ALL)
    SELECT clase, anio, semana, previa FROM (SELECT *, lag(semana) OVER w AS previa, lag(v) OVER w AS antes FROM b
        WINDOW w AS (PARTITION BY clase, anio ORDER BY semana)) WHERE v = antes""",
)
def w10(spark, d):
    return cumulative.reprints(current_cuts(spark, d), ["clase"])


@check(
    "W11_monotonicity",
    """SELECT clase, count(*) FILTER (acum > antes) AS crecientes, count(*) FILTER (acum = antes) AS iguales,
        count(*) FILTER (acum < antes) AS decrecientes FROM pasos WHERE previa IS NOT NULL GROUP BY clase""",
)
def w11(spark, d):
    return cumulative.monotonicity(current_cuts(spark, d), KEYS, ["clase"])


@check("F5_safe_rows", "SELECT clase, region, anio, semana, valor FROM puntos WHERE trim(nota) = ''")
def f5(spark, d):
    return cumulative.safe_points(points(spark, d)).select(*KEYS, "anio", "semana", "valor")


@check(
    "J9_point_provenance",
    """SELECT p.clase, p.region, p.anio, p.semana, p.valor, v.archivo FROM puntos p
    LEFT JOIN vigentes v USING (clase, region, anio, semana)""",
)
def j9(spark, d):
    cuts = current_cuts(spark, d)
    return cumulative.with_origin(cumulative.deaccumulate(cuts, KEYS), cuts, KEYS).drop("nota", "tipo")


@check(
    "T13_case_load",
    """SELECT p.clase, p.region, p.anio, p.semana, CAST(p.valor AS INTEGER) AS conteo, v.archivo FROM puntos p
    LEFT JOIN vigentes v USING (clase, region, anio, semana) WHERE p.valor IS NOT NULL""",
)
def t13(spark, d):
    cuts = current_cuts(spark, d)
    return cumulative.case_rows(cumulative.with_origin(cumulative.deaccumulate(cuts, KEYS), cuts, KEYS))


@check(
    "T13_load_counters",
    """SELECT count(valor) AS insertadas, count(*) FILTER (tipo = 'hueco') AS huecos_omitidos,
        count(*) FILTER (tipo = 'correccion') AS correcciones_omitidas FROM puntos""",
)
def t13_counters(spark, d):
    return cumulative.load_counters(points(spark, d))


@check(
    "A11_yearly_distribution",
    f"""SELECT clase, region, anio, count(valor) AS semanas_con_dato, count(p.semana) AS semanas_registradas, sum(valor) AS total_anual,
        median(valor) AS mediana_semanal, max(valor) AS maximo_semanal, count(*) FILTER (valor = 0) / nullif(count(valor), 0) AS fraccion_cero
    FROM (SELECT clase, region, unnest([1995, 1996, 1997, 1999, 2000]) AS anio FROM (SELECT DISTINCT clase, region FROM puntos))
    LEFT JOIN puntos p USING (clase, region, anio) GROUP BY ALL""",
)
def a11(spark, d):
    return cumulative.yearly_distribution(points(spark, d), KEYS, A.BASE_YEARS)


view(
    "canal_semana",
    f"""SELECT g.clase, g.region, g.semana, anio_objetivo, count(h.valor) AS n_obs, count(DISTINCT h.anio) AS anios_presentes,
        list(h.valor ORDER BY h.valor) FILTER (h.valor IS NOT NULL) AS pool
    FROM (SELECT clase, region, semana, unnest([1995, 1996, 1997, 1999, 2000]) AS anio_objetivo
          FROM (SELECT clase, region, unnest(generate_series(1, 52)) AS semana FROM (SELECT DISTINCT clase, region FROM puntos))) g
    LEFT JOIN (SELECT * FROM puntos WHERE valor IS NOT NULL AND anio IN {BASE_YEARS}) h
        ON h.clase = g.clase AND h.region = g.region AND h.semana = g.semana AND h.anio <> g.anio_objetivo
    GROUP BY ALL""",
)


@check(
    "P7_same_week_quartiles",
    f"""SELECT clase, region, CAST(semana AS INTEGER) AS semana, anio_objetivo, n_obs, anios_presentes, n_obs >= 12 AND anios_presentes >= 3 AS suficiente,
        {pct('pool', 0.25)} AS p25, {pct('pool', 0.5)} AS p50, {pct('pool', 0.75)} AS p75 FROM canal_semana""",
)
def p7(spark, d):
    return channel.same_week_channel(points(spark, d), KEYS, A.BASE_YEARS)


@check(
    "P7_zero_upper_quartiles",
    f"""SELECT clase, count(*) AS celdas, count(*) FILTER ({pct('pool', 0.75)} = 0) AS q3_cero, count(*) FILTER ({pct('pool', 0.75)} = 0) / count(*) AS fraccion_q3_cero,
        count(*) FILTER (NOT (n_obs >= 12 AND anios_presentes >= 3)) AS bajo_piso FROM canal_semana GROUP BY clase""",
)
def p7_zero(spark, d):
    return channel.same_week_summary(channel.same_week_channel(points(spark, d), KEYS, A.BASE_YEARS), ["clase"])


@check(
    "A12_loss_audit",
    f"""WITH j AS (SELECT p.*, c.n_obs, {pct('c.pool', 0.75)} AS p75 FROM puntos p LEFT JOIN canal_semana c
            ON c.clase = p.clase AND c.region = p.region AND c.semana = p.semana AND c.anio_objetivo = p.anio),
        a AS (SELECT clase, region, count(*) AS n, count(*) FILTER (valor IS NULL) AS sin, list(DISTINCT anio) FILTER (n_obs >= 2 AND valor > p75) AS con
            FROM j GROUP BY ALL)
    SELECT clase, region, n AS semanas_registradas, sin AS semanas_sin_dato, sin / n AS fraccion_perdida, sin / n > 0.2 AS pierde_mas_20,
        coalesce(len(con), 0) AS anios_con_alta,
        coalesce(array_to_string([CAST(y AS VARCHAR) for y in [1995, 1996, 1997, 1999, 2000] if NOT list_contains(coalesce(con, []), y)], ','), '') AS anios_sin_alta FROM a""",
)
def a12(spark, d):
    pts = points(spark, d)
    cells = channel.same_week_channel(pts, KEYS, A.BASE_YEARS).select(
        *KEYS, "semana", F.col("anio_objetivo").alias("anio"), "n_obs", "p75"
    )
    return cumulative.loss_audit(pts, cells, KEYS, A.BASE_YEARS)


@check(
    "Q11_missing_weeks_per_year",
    "SELECT region, anio, count(*) FILTER (valor IS NULL) AS semanas_sin_dato FROM puntos WHERE clase = 'notificado' GROUP BY ALL",
)
def q11(spark, d):
    return cumulative.missing_weeks(points(spark, d).filter("clase = 'notificado'"), ["region"])


@check(
    "K7_nested_series",
    """WITH p AS (SELECT region, anio, semana, '[' || semana || ',' || coalesce(CAST(CAST(valor AS BIGINT) AS VARCHAR), 'null') ||
            CASE WHEN nota = '' THEN '' ELSE ',"' || nota || '"' END || ']' AS t FROM puntos WHERE clase = 'notificado'),
        y AS (SELECT region, anio, '"' || anio || '":[' || string_agg(t, ',' ORDER BY semana) || ']' AS t FROM p GROUP BY region, anio)
    SELECT region, '{' || string_agg(t, ',' ORDER BY anio) || '}' AS series FROM y GROUP BY region""",
)
def k7(spark, d):
    return cumulative.nested_series(points(spark, d).filter("clase = 'notificado'"), "region")


_BREAK = "v[CAST(floor({p}::DOUBLE * (len(v) - 1)) AS BIGINT) + 1]"
view(
    "totales_region",
    """SELECT r.region, nullif(coalesce(sum(conteo) FILTER (clasificacion = 'probable'), 0)::BIGINT, 0) AS total
    FROM regiones r LEFT JOIN facts f ON f.region = r.region AND f.fuente = '2-HIGH' GROUP BY ALL""",
)


@check(
    "P17_map_breaks",
    f"""WITH o AS (SELECT list(total ORDER BY total) FILTER (total IS NOT NULL) AS v FROM totales_region),
        b AS (SELECT {', '.join(_BREAK.format(p=p) + f' AS b{i}' for i, p in enumerate((0.2, 0.4, 0.6, 0.8)))} FROM o)
    SELECT region, total, CASE WHEN total IS NULL THEN NULL WHEN total <= b0 THEN 0 WHEN total <= b1 THEN 1
        WHEN total <= b2 THEN 2 WHEN total <= b3 THEN 3 ELSE 4 END AS tramo FROM totales_region, b""",
)
def p17(spark, d):
    fact = A.facts(spark, d).filter(F.col("fuente") == "2-HIGH")
    rows = summary.region_case_summary(A.regions(spark, d), fact).join(
        A.regions(spark, d).select("codigo", "region"), "codigo"
    )
    totals = rows.select("region", F.nullif("probable_total", F.lit(0)).alias("total"))
    return summary.map_breaks(totals, "total")

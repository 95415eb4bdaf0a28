"""Calendar, filter, join, set and sort queries."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks.base import BASE_YEARS, check, mmwr, observed, view, week_start
from weekwatch.functions import calendar as cal
from weekwatch.functions.text import place_key
from weekwatch.operators import calendar as C
from weekwatch.operators import integrity, joins, summary, upsert
from weekwatch.plans import adapters as A
from weekwatch.session import stored

ORDER_WEEK = week_start("o_orderdate")
Y, W = mmwr("fecha")

view(
    "facts",
    f"""SELECT region, CASE WHEN clasificacion = 'notificado' THEN 'ira' ELSE 'dengue' END AS evento,
        {Y} AS anio, {W} AS semana, clasificacion, fuente, fecha, count(*) AS conteo
    FROM (SELECT c_nationkey AS region, {ORDER_WEEK} AS fecha, o_orderpriority AS fuente,
            CASE o_orderstatus WHEN 'F' THEN 'confirmado' WHEN 'O' THEN 'probable' WHEN 'P' THEN 'notificado' END AS clasificacion
          FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL""",
)


# --- calendar -------------------------------------------------------------


@check("C1_mmwr_calendar", "SELECT * FROM cal")
def c1(spark, d):
    return A.calendar(spark, d)


@check(
    "C2_date_to_week",
    f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dia, CAST(year(fecha + 3) AS INTEGER) AS anio, {W} AS semana
    FROM (SELECT *, {ORDER_WEEK} AS fecha FROM orders)""",
)
def c2(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dia"))
    return C.with_week(rows, "dia")


@check(
    "C3_days_by_calendar",
    """SELECT d.region, d.fecha, c.anio, c.semana FROM daily d
    JOIN cal c ON d.fecha BETWEEN c.fecha_inicio AND c.fecha_fin""",
)
def c3(spark, d):
    days = A.daily_wide(spark, d).select("region", "fecha")
    return C.join_days(days, A.calendar(spark, d))[0]


@check(
    "C3_days_without_week",
    """SELECT DISTINCT fecha FROM daily WHERE NOT EXISTS (
        SELECT 1 FROM cal c WHERE c.anio <> 1998 AND fecha BETWEEN c.fecha_inicio AND c.fecha_fin)""",
)
def c3_missing(spark, d):
    days = A.daily_wide(spark, d).select("fecha")
    return C.join_days(days, A.calendar(spark, d).filter(F.col("anio") != A.EXCLUDED_YEAR))[1]


@check(
    "C4_week_by_start_date",
    """SELECT CASE WHEN c.anio IS NULL THEN 'sin_semana' WHEN c.anio BETWEEN 1996 AND 2000 THEN 'en_rango'
        ELSE 'fuera_de_rango' END AS estado, count(*) AS fechas, sum(n)::BIGINT AS casos
    FROM (SELECT CAST(o_orderdate AS DATE) AS dia, count(*) AS n FROM orders GROUP BY 1) o
    LEFT JOIN cal c ON o.dia = c.fecha_inicio GROUP BY 1""",
)
def c4(spark, d):
    days = (
        A.table(spark, d, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("fecha_inicio"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found, missing = C.join_week_start(days, A.calendar(spark, d))
    inside = F.when(F.col("anio").between(1996, 2000), "en_rango").otherwise("fuera_de_rango")
    states = found.select(inside.alias("estado"), "n").unionByName(
        missing.select(F.lit("sin_semana").alias("estado"), "n")
    )
    return states.groupBy("estado").agg(F.count(F.lit(1)).alias("fechas"), F.sum("n").alias("casos"))


@check(
    "C5_chronological_index",
    """SELECT anio, semana, CAST(date_diff('day', DATE '1970-01-04', fecha_inicio) // 7 AS INTEGER) AS indice,
        row_number() OVER (ORDER BY fecha_inicio) - 1 + (SELECT min(date_diff('day', DATE '1970-01-04', fecha_inicio) // 7) FROM cal) AS posicion
    FROM cal""",
)
def c5(spark, d):
    index = cal.week_index(F.col("fecha_inicio"))
    return A.calendar(spark, d).select("anio", "semana", index.alias("indice"), index.cast("bigint").alias("posicion"))


view("semanas_region", "SELECT DISTINCT region, clase, anio, fecha FROM obs")
view(
    "ordinales",
    """SELECT region, clase, anio, fecha, CAST(row_number() OVER (PARTITION BY region, clase, anio ORDER BY fecha) AS INTEGER) AS semana,
        CAST(count(*) OVER (PARTITION BY region, clase, anio) AS INTEGER) AS n_semanas FROM semanas_region""",
)


def ordinal(spark, d):
    return C.ordinal_weeks(A.obs(spark, d).select("region", "clase", "anio", "fecha"), ["region", "clase"])


@check("C6_ordinal_weeks", "SELECT * FROM ordinales")
def c6(spark, d):
    return ordinal(spark, d)


@check(
    "C4_load_counters",
    """SELECT count(*) AS leidas, count(*) FILTER (c.anio IS NULL) AS sin_semana, count(*) FILTER (c.anio NOT BETWEEN 1996 AND 2000) AS fuera_de_rango,
        count(*) FILTER (c.anio BETWEEN 1996 AND 2000) AS cargadas
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dia FROM orders) o LEFT JOIN cal c ON o.dia = c.fecha_inicio""",
)
def c4_counters(spark, d):
    """Counted by the job that writes the rows."""
    days = A.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("fecha_inicio")).distinct()
    seen = Observation("semanas")
    stored(C.weeks_in_years(days, A.calendar(spark, d), 1996, 2000, seen))
    return observed(spark, seen)


@check(
    "C7_missing_months",
    """SELECT count(*) AS semanas, count(*) FILTER (i.anom IS NULL) AS sin_dato FROM cal c LEFT JOIN idx i
    ON i.anio = year(c.fecha_inicio) AND i.mes = month(c.fecha_inicio)""",
)
def c7_missing(spark, d):
    seen = Observation("meses")
    stored(C.monthly_to_weekly(A.monthly_index(spark, d), A.calendar(spark, d), seen=seen))
    return observed(spark, seen)


@check(
    "C7_monthly_index_to_weeks",
    """SELECT c.*, i.anom FROM cal c LEFT JOIN idx i
    ON i.anio = year(c.fecha_inicio) AND i.mes = month(c.fecha_inicio)""",
)
def c7(spark, d):
    return C.monthly_to_weekly(A.monthly_index(spark, d), A.calendar(spark, d))


@check(
    "C8_step_back_weeks",
    """WITH t AS (SELECT *, anio - dense_rank() OVER (PARTITION BY region, clase ORDER BY anio) AS tramo FROM ordinales),
    p AS (SELECT *, row_number() OVER (PARTITION BY region, clase, tramo ORDER BY anio, semana) AS pos FROM t)
    SELECT o.region, o.clase, o.anio, o.semana, o.fecha, o.n_semanas, b.anio AS anio_previo, b.semana AS semana_previa
    FROM p o LEFT JOIN p b ON b.region = o.region AND b.clase = o.clase AND b.tramo = o.tramo AND b.pos = o.pos - 3""",
)
def c8(spark, d):
    return C.step_back(ordinal(spark, d), ["region", "clase"], 3)


@check(
    "C9_contiguous_history",
    """SELECT t.region, t.clase, t.anio, t.semana, count(h.fecha) = 4 AS historia_completa
    FROM obs t LEFT JOIN obs h ON h.region = t.region AND h.clase = t.clase
        AND h.fecha BETWEEN t.fecha - 28 AND t.fecha - 7 GROUP BY ALL""",
)
def c9(spark, d):
    rows = C.contiguous_history(A.obs(spark, d), ["region", "clase"], 4)
    return rows.select("region", "clase", "anio", "semana", "historia_completa")


# --- filters --------------------------------------------------------------


@check(
    "F1_equality_filters",
    """SELECT f.* FROM facts f JOIN regiones r USING (region)
    WHERE r.padre = 'EUROPE' AND clasificacion = 'confirmado' AND fuente = '1-URGENT'""",
)
def f1(spark, d):
    region = A.regions(spark, d).filter(F.col("padre") == "EUROPE").select("region")
    keep = (F.col("clasificacion") == "confirmado") & (F.col("fuente") == "1-URGENT")
    return A.facts(spark, d).filter(keep).join(region, "region", "left_semi")


@check(
    "F2_membership_filters",
    f"""SELECT region, clase, anio, semana, conteo FROM obs WHERE anio IN (1995, 1996, 1997, 1999, 2000, 2001)
        AND semana IN (19, 20, 21) AND clase IN ('probable', 'confirmado')""",
)
def f2(spark, d):
    years = sorted({*A.BASE_YEARS, 2001})
    keep = F.col("anio").isin(*years) & F.col("semana").isin(19, 20, 21) & F.col("clase").isin("probable", "confirmado")
    return A.obs(spark, d).filter(keep).drop("fecha")


@check(
    "F3_epidemiological_year_range",
    f"""SELECT o_orderkey, CAST(year(fecha + 3) AS INTEGER) AS anio, {W} AS semana, CAST(year(o_orderdate) AS INTEGER) AS anio_calendario
    FROM (SELECT *, {ORDER_WEEK} AS fecha FROM orders) WHERE year(fecha + 3) BETWEEN 1996 AND 1998""",
)
def f3(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dia"))
    return (
        C.with_week(rows, "dia")
        .filter(F.col("anio").between(1996, 1998))
        .select("o_orderkey", "anio", "semana", F.year("dia").alias("anio_calendario"))
    )


# --- joins ----------------------------------------------------------------


@check(
    "J1_star_join",
    """SELECT r.nombre, f.fuente, c.fecha_inicio, c.fecha_fin, f.clasificacion, f.conteo
    FROM facts f JOIN regiones r USING (region) JOIN (SELECT DISTINCT o_orderpriority AS fuente FROM orders) s USING (fuente)
    JOIN cal c USING (anio, semana)""",
)
def j1(spark, d):
    dims = [
        (A.regions(spark, d).select("region", "nombre"), ["region"]),
        (A.sources(spark, d), ["fuente"]),
        (A.calendar(spark, d), ["anio", "semana"]),
    ]
    return joins.star(A.facts(spark, d), dims).select(
        "nombre", "fuente", "fecha_inicio", "fecha_fin", "clasificacion", "conteo"
    )


@check(
    "J2_left_join_filter_in_on",
    """SELECT r.region, r.nombre, f.clasificacion, f.anio, f.conteo FROM regiones r LEFT JOIN facts f
    ON f.region = r.region AND f.semana = 53 AND f.fuente = (SELECT min(o_orderpriority) FROM orders)""",
)
def j2(spark, d):
    first = A.table(spark, d, "orders").agg(F.min("o_orderpriority").alias("fuente"))
    fact = A.facts(spark, d).join(F.broadcast(first), "fuente", "left_semi")
    return joins.keep_left(A.regions(spark, d), fact, ["region"], F.col("semana") == 53).select(
        "region", "nombre", "clasificacion", "anio", "conteo"
    )


@check(
    "J6_place_name_join",
    """SELECT f.anio, r.codigo, r.region, sum(conteo)::BIGINT AS conteo FROM facts f JOIN regiones r USING (region) GROUP BY ALL""",
)
def j6(spark, d):
    named = joins.by_place_name(A.reported_names(spark, d), A.regions(spark, d), "lugar")
    return named.select("anio", "codigo", "region", "conteo")


@check(
    "J6_place_name_completeness",
    """SELECT count(DISTINCT region) AS nombres, 0::BIGINT AS sin_pareja, count(DISTINCT region) AS encontradas,
        (SELECT count(*) FROM nation) AS esperadas FROM facts""",
)
def j6_report(spark, d):
    return joins.name_match_report(A.reported_names(spark, d), A.regions(spark, d), "lugar")


@check(
    "J7_required_lookup",
    "SELECT region, anio, sum(conteo)::BIGINT AS conteo FROM facts GROUP BY ALL",
)
def j7(spark, d):
    rows = A.reported_names(spark, d).withColumn("clave", place_key(F.col("lugar"))).drop("lugar")
    dim = A.regions(spark, d).select(place_key(F.col("nombre")).alias("clave"), "region")
    joins.require_all(dim, rows, ["clave"])
    return joins.require_match(rows, dim, ["clave"]).select("region", "anio", "conteo")


@check(
    "J8_anti_join_audit",
    """SELECT 'sin_calendario' AS auditoria, anio || '|' || semana AS clave FROM (SELECT DISTINCT anio, semana FROM facts
        WHERE anio = 1998)
    UNION ALL SELECT 'region_sin_datos', CAST(region AS VARCHAR) FROM regiones
        WHERE region NOT IN (SELECT region FROM facts WHERE semana = 53 AND fuente = '1-URGENT' AND clasificacion = 'notificado')""",
)
def j8(spark, d):
    fact = A.facts(spark, d)
    weeks = A.calendar(spark, d).filter(F.col("anio") != A.EXCLUDED_YEAR)
    no_week = joins.missing_keys(fact, weeks, ["anio", "semana"]).select(
        F.lit("sin_calendario").alias("auditoria"), F.concat_ws("|", "anio", "semana").alias("clave")
    )
    rare = fact.filter((F.col("semana") == 53) & (F.col("fuente") == "1-URGENT") & (F.col("clasificacion") == "notificado"))
    no_data = joins.missing_keys(A.regions(spark, d), rare, ["region"]).select(
        F.lit("region_sin_datos").alias("auditoria"), F.col("region").cast("string").alias("clave")
    )
    return no_week.unionByName(no_data)


# --- aggregations ---------------------------------------------------------


@check(
    "A5_region_case_summary",
    """SELECT r.nombre, r.codigo, coalesce(sum(conteo) FILTER (clasificacion = 'probable'), 0)::BIGINT AS probable_total,
        coalesce(sum(conteo) FILTER (clasificacion = 'confirmado'), 0)::BIGINT AS confirmado_total,
        count(DISTINCT anio || '-' || semana) FILTER (clasificacion = 'probable') AS semanas_con_dato_probable,
        min(anio) AS primer_anio, max(anio) AS ultimo_anio
    FROM regiones r LEFT JOIN facts f ON f.region = r.region AND f.fuente = '2-HIGH' GROUP BY ALL""",
)
def a5(spark, d):
    fact = A.facts(spark, d).filter(F.col("fuente") == "2-HIGH")
    return summary.region_case_summary(A.regions(spark, d), fact)


@check(
    "A6_single_class_summary",
    """SELECT r.nombre, r.codigo, coalesce(sum(conteo), 0)::BIGINT AS notificado_total, count(conteo) AS semanas_con_dato,
        min(anio) AS primer_anio, max(anio) AS ultimo_anio
    FROM regiones r LEFT JOIN facts f ON f.region = r.region AND f.clasificacion = 'notificado' GROUP BY ALL""",
)
def a6(spark, d):
    return summary.region_class_summary(A.regions(spark, d), A.facts(spark, d), "notificado")


@check(
    "A7_weekly_series",
    "SELECT region, clasificacion, anio, semana, sum(conteo)::BIGINT AS conteo FROM facts GROUP BY ALL",
)
def a7(spark, d):
    return summary.weekly_series(A.facts(spark, d), ["region", "clasificacion"])


@check(
    "A8_national_kpis",
    """SELECT sum(conteo)::BIGINT AS total, max(conteo) AS pico,
        (SELECT min(fecha) FROM obs_nat WHERE conteo = (SELECT max(conteo) FROM obs_nat)) AS fecha_pico,
        min(anio) AS primer_anio, max(anio) AS ultimo_anio, count(*) AS semanas, min(fecha) AS primera_semana,
        max(fecha) AS ultima_semana, max(conteo) / 2 AS nivel_medio FROM obs_nat""",
)
def a8(spark, d):
    return summary.national_kpis(A.obs_national(spark, d))


@check(
    "A8_first_week_per_year",
    "SELECT anio, min(fecha) AS primera_fecha, arg_min(semana, fecha) AS primera_semana FROM obs_nat GROUP BY anio",
)
def a8_years(spark, d):
    return summary.first_week_per_year(A.obs_national(spark, d))


@check(
    "A13_volume_and_qualification",
    f"""SELECT region, sum(v) AS volumen_total, count(*) FILTER (n >= 8) AS anios_con_actividad,
        count(*) FILTER (n >= 8) >= 3 AS califica
    FROM (SELECT region, anio, sum(conteo)::DOUBLE AS v, count(*) AS n
          FROM (SELECT region, anio, semana, sum(conteo) AS conteo FROM obs WHERE clase <> 'notificado' AND anio IN {BASE_YEARS} GROUP BY ALL)
          GROUP BY ALL) GROUP BY region""",
)
def a13(spark, d):
    return summary.volume_ranking(lab_series(spark, d), "region", A.BASE_YEARS)


def lab_series(spark, d):
    """Both laboratory series of a region added together."""
    rows = A.obs(spark, d).filter(F.col("clase").isin("probable", "confirmado"))
    return rows.groupBy("region", "anio", "semana").agg(F.sum("conteo").cast("double").alias("valor"))


@check(
    "W17_volume_rank",
    f"""SELECT region, volumen_total, row_number() OVER (ORDER BY volumen_total DESC, region) AS puesto
    FROM (SELECT region, sum(conteo)::DOUBLE AS volumen_total FROM obs
          WHERE clase <> 'notificado' AND anio IN {BASE_YEARS} GROUP BY region)""",
)
def w17(spark, d):
    volumes = summary.volume_ranking(lab_series(spark, d), "region", A.BASE_YEARS)
    return summary.rank_by_volume(volumes, "region").select("region", "volumen_total", "puesto")


@check(
    "A19_complete_entities",
    f"""SELECT region, clase, count(*) AS anios_completos FROM (SELECT region, clase, anio FROM semanas_region WHERE anio IN {BASE_YEARS}
        GROUP BY ALL HAVING count(*) >= 15) GROUP BY region, clase HAVING count(*) = 5""",
)
def a19(spark, d):
    return summary.coverage(A.obs(spark, d), ["region", "clase"], A.BASE_YEARS, 15)


# --- sets, sorts ----------------------------------------------------------


@check(
    "U1_union_all",
    """SELECT region, fecha, 'temp_media' AS variable, temp_media AS milesimas FROM daily
    UNION ALL SELECT region, fecha, 'precipitation_sum', precipitation_sum FROM daily WHERE precipitation_sum IS NOT NULL""",
)
def u1(spark, d):
    days = A.daily_wide(spark, d)
    points = lambda v: days.select(
        "region", "fecha", F.lit(v).alias("variable"), F.col(v).alias("milesimas")
    ).filter(F.col(v).isNotNull())
    return points("temp_media").unionByName(points("precipitation_sum"))


@check(
    "U2_week_intersection",
    """SELECT anio, semana FROM obs WHERE clase = 'probable' INTERSECT SELECT anio, semana FROM obs WHERE clase = 'confirmado'""",
)
def u2(spark, d):
    weeks = A.obs(spark, d)
    one = lambda c: weeks.filter(F.col("clase") == c).select("anio", "semana")
    return one("probable").intersect(one("confirmado"))


@check(
    "U3_set_difference",
    """SELECT anio, semana FROM cal EXCEPT SELECT anio, semana FROM obs""",
)
def u3(spark, d):
    present = A.obs(spark, d).select("anio", "semana").distinct()
    return A.calendar(spark, d).select("anio", "semana").exceptAll(present)


@check("U4_weeks_seen", "SELECT DISTINCT region, semana FROM obs")
def u4(spark, d):
    return A.obs(spark, d).select("region", "semana").distinct()


@check("L1_multi_key_sort", "SELECT region, clase, anio, semana, conteo FROM obs ORDER BY region, anio, semana, clase")
def l1(spark, d):
    return A.obs(spark, d).drop("fecha").orderBy("region", "anio", "semana", "clase")


@check(
    "L2_latest_row",
    "SELECT anio, semana, conteo FROM obs_nat ORDER BY anio DESC, semana DESC LIMIT 1",
)
def l2(spark, d):
    return A.obs_national(spark, d).drop("fecha").orderBy(F.desc("anio"), F.desc("semana")).limit(1)


@check(
    "L3_top_k",
    "SELECT region, clase, anio, semana, conteo FROM obs ORDER BY conteo DESC, region, clase, anio, semana LIMIT 10",
)
def l3(spark, d):
    return A.obs(spark, d).drop("fecha").orderBy(F.desc("conteo"), "region", "clase", "anio", "semana").limit(10)


# --- writes and integrity -------------------------------------------------

NATURAL = ["region", "evento", "anio", "semana", "clasificacion", "fuente"]


def _old_and_new(spark, d):
    fact = A.facts(spark, d).drop("fecha")
    old = fact.filter(F.col("anio") <= 2000).withColumn("carga", F.lit(1))
    new = fact.filter(F.col("anio") >= 2000).withColumns({"conteo": F.col("conteo") + 1, "carga": F.lit(2)})
    return old, new


view("hechos_viejos", "SELECT * EXCLUDE (fecha), 1 AS carga FROM facts WHERE anio <= 2000")
view("hechos_nuevos", "SELECT * EXCLUDE (fecha) REPLACE (conteo + 1 AS conteo), 2 AS carga FROM facts WHERE anio >= 2000")


@check(
    "K1_upsert",
    f"""SELECT * FROM hechos_nuevos UNION ALL SELECT v.* FROM hechos_viejos v
    ANTI JOIN hechos_nuevos n USING ({', '.join(NATURAL)})""",
)
def k1(spark, d):
    old, new = _old_and_new(spark, d)
    return upsert.upsert(old, new, NATURAL)


@check(
    "K2_insert_if_absent",
    f"""SELECT * FROM hechos_viejos UNION ALL SELECT n.* FROM hechos_nuevos n
    ANTI JOIN hechos_viejos v USING ({', '.join(NATURAL)})""",
)
def k2(spark, d):
    old, new = _old_and_new(spark, d)
    return upsert.insert_absent(old, new, NATURAL)


@check(
    "K4_attribute_update",
    """WITH nuevo AS (SELECT s_nationkey AS region, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) % 2 = 0)
    SELECT r.region, r.nombre, coalesce(CAST(n.n AS DOUBLE) / 2, CAST(r.region AS DOUBLE)) AS elevacion_m
    FROM regiones r LEFT JOIN nuevo n USING (region)""",
)
def k4(spark, d):
    dim = A.regions(spark, d).select("region", "nombre", F.col("region").cast("double").alias("elevacion_m"))
    news = (
        A.table(spark, d, "supplier")
        .groupBy(F.col("s_nationkey").alias("region"))
        .agg((F.count(F.lit(1)) / 2).alias("elevacion_m"), F.count(F.lit(1)).alias("n"))
        .filter("n % 2 = 0")
    )
    return upsert.update_attributes(dim, news, ["region"], ["elevacion_m"])


@check(
    "K6_constraint_violations",
    """WITH malos AS (SELECT * REPLACE (CASE WHEN anio = 1999 AND semana = 7 THEN -conteo ELSE conteo END AS conteo,
            CASE WHEN clasificacion = 'probable' AND anio = 1996 AND semana = 3 THEN 'sospechoso' ELSE clasificacion END AS clasificacion)
        FROM facts UNION ALL SELECT * FROM facts WHERE anio = 1997 AND semana = 1),
    k AS (SELECT *, concat_ws('|', region, evento, anio, semana, clasificacion, fuente) AS clave FROM malos)
    SELECT 'fk_calendario' AS regla, anio || '|' || semana AS clave, count(*) AS filas FROM malos WHERE anio = 1998 GROUP BY ALL
    UNION ALL SELECT 'clave_unica', clave, count(*) FROM k GROUP BY clave HAVING count(*) > 1
    UNION ALL SELECT 'dominio_clasificacion', clave, count(*) FROM k WHERE clasificacion = 'sospechoso' GROUP BY clave
    UNION ALL SELECT 'conteo_negativo', clave, count(*) FROM k WHERE conteo < 0 GROUP BY clave""",
)
def k6(spark, d):
    fact = A.facts(spark, d)
    negative = (F.col("anio") == 1999) & (F.col("semana") == 7)
    renamed = (F.col("clasificacion") == "probable") & (F.col("anio") == 1996) & (F.col("semana") == 3)
    broken = fact.withColumns(
        {
            "conteo": F.when(negative, -F.col("conteo")).otherwise(F.col("conteo")),
            "clasificacion": F.when(renamed, "sospechoso").otherwise(F.col("clasificacion")),
        }
    ).unionByName(fact.filter((F.col("anio") == 1997) & (F.col("semana") == 1)))
    weeks = A.calendar(spark, d).filter(F.col("anio") != A.EXCLUDED_YEAR)
    return integrity.case_fact_violations(broken, weeks, A.regions(spark, d), A.sources(spark, d))

"""Source and sink queries: tables derived from the driver data are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks.base import check, view
from checks.baselines import national
from checks.counters import files as bulletin_files_of
from checks.weather import NAMES, training_rows
from weekwatch.functions import text
from weekwatch.operators import channel, upsert
from weekwatch.plans import adapters as A
from weekwatch.session import new_path
from weekwatch.sources import case_csv, climate_index, sql_dump, tables, weather_json, writers


def _extract_rows(spark, d):
    """Weekly case extract per nation, with sub-national rows that readers must skip."""
    names = A.regions(spark, d).select("region", F.col("codigo").alias("adm_0_name"))
    weeks = A.obs(spark, d).groupBy("region", "semana", "fecha").agg(F.sum("conteo").alias("dengue_total"))
    levels = F.explode(F.array(F.lit("Admin0"), F.lit("Admin1")))
    return weeks.join(names, "region").select(
        "region", "semana", "adm_0_name",
        F.year("fecha").alias("Year"),
        F.col("fecha").alias("calendar_start_date"),
        F.date_add("fecha", 6).alias("calendar_end_date"),
        levels.alias("S_res"),
        F.lit("Week").alias("T_res"),
        F.lit("Total").alias("case_definition_standardised"),
        F.col("dengue_total").cast("string").alias("dengue_total"),
    )


view("extracto", "SELECT codigo AS pais, region, semana, anio, fecha, sum(conteo)::BIGINT AS conteo FROM obs JOIN regiones USING (region) GROUP BY ALL")


def clean_extract(spark, d):
    path = new_path(spark, "extracto")
    writers.csv(_extract_rows(spark, d).select(*case_csv.COLUMNS), path)
    return path


@check("S1_national_case_csv", "SELECT pais, fecha AS fecha_inicio, conteo FROM extracto")
def s1(spark, d):
    return case_csv.national_weeks(spark, clean_extract(spark, d))


@check(
    "S2_lenient_case_csv",
    """SELECT pais, CAST(year(fecha) AS INTEGER) AS anio, fecha, conteo::DOUBLE AS valor FROM extracto
    WHERE (region + semana) % 13 <> 0 AND year(fecha) BETWEEN 1995 AND 2000""",
)
def s2(spark, d):
    rows = _extract_rows(spark, d)
    mark = F.col("region") + F.col("semana")
    printed = F.when(mark % 13 == 0, F.array(F.lit("NA"))).when(
        mark % 7 == 0, F.array((F.col("dengue_total").cast("int") + 5).cast("string"), F.col("dengue_total"))
    ).otherwise(F.array("dengue_total"))
    messy = rows.withColumn("dengue_total", F.explode(printed)).select(*case_csv.COLUMNS)
    path = new_path(spark, "extracto-sucio")
    writers.csv(messy, path)
    return case_csv.lenient_weeks(spark, path, range(1995, 2001))


@check(
    "S3_strict_case_csv",
    """SELECT pais, anio, semana, fecha, conteo::DOUBLE AS valor, CAST(year(fecha) AS INTEGER) AS anio_declarado
    FROM extracto WHERE anio BETWEEN 1996 AND 2000""",
)
def s3(spark, d):
    filters = {"S_res": "Admin0", "T_res": "Week", "case_definition_standardised": "Total"}
    return case_csv.strict_weeks(spark, clean_extract(spark, d), filters, 1996, 2000)


def weather_responses(spark, d):
    """Write daily weather as numbered API responses of ten locations and read them back."""
    days = A.daily_wide(spark, d)
    stored = {v: k for k, v in weather_json.VARIABLES.items()}
    value = lambda v: (F.col(v) / F.lit(1000.0)).alias(stored[v])
    day = F.struct(F.col("fecha").cast("string").alias("time"), *[value(v) for v in A.VARIABLES])
    located = days.groupBy("region").agg(F.array_sort(F.collect_list(day)).alias("dias"))
    fields = ["time", *weather_json.VARIABLES]
    response = F.struct(
        F.col("region").alias("region"),
        (F.col("region") / F.lit(2.0)).alias("latitude"),
        (F.col("region") * F.lit(-1.0)).alias("longitude"),
        (F.col("region") * F.lit(10.0)).alias("elevation"),
        F.struct(*[F.col(f"dias.{f}").alias(f) for f in fields]).alias("daily"),
    )
    lot = F.floor(F.col("region") / 10).cast("int")
    requests = located.select(lot.alias("lote"), response.alias("r")).groupBy("lote").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    path = new_path(spark, "clima")
    bodies = F.to_json(F.transform("rs", lambda r: r.dropFields("region")))
    requests.select("lote", bodies.alias("value")).write.partitionBy("lote").text(path)
    order = Window.partitionBy("lote").orderBy("region")
    locations = days.select("region").distinct().withColumn("lote", lot)
    locations = locations.withColumn("posicion", F.row_number().over(order) - 1)
    return weather_json.responses(spark, path, locations)


@check(
    "S4_daily_weather_json",
    "SELECT region, fecha, variable, m / 1000.0::DOUBLE AS valor FROM dia_largo",
)
def s4(spark, d):
    points = weather_json.points(weather_responses(spark, d))
    return points.withColumn("valor", F.col("valor").cast("double"))


@check(
    "K4_location_attributes",
    """SELECT r.region, r.nombre, CASE WHEN hay THEN r.region / 2 END AS lat, CASE WHEN hay THEN r.region * -1.0::DOUBLE END AS lon,
        CASE WHEN hay THEN r.region * 10.0::DOUBLE END AS elevacion_m
    FROM (SELECT *, EXISTS (FROM daily WHERE daily.region = regiones.region) AS hay FROM regiones) r""",
)
def k4_locations(spark, d):
    missing = F.lit(None).cast("double")
    dim = A.regions(spark, d).select("region", "nombre", missing.alias("lat"), missing.alias("lon"), missing.alias("elevacion_m"))
    found = weather_json.elevations(weather_responses(spark, d)).withColumnRenamed("elevation", "elevacion_m")
    return upsert.update_attributes(dim, found, ["region"], ["lat", "lon", "elevacion_m"])


@check("S5_climate_index_text", "SELECT anio, mes, anom FROM idx")
def s5(spark, d):
    codes = F.create_map(*[F.lit(x) for k, v in climate_index.CENTRAL_MONTH.items() for x in (v, k)])
    line = F.concat_ws(
        "   ", F.element_at(codes, F.col("mes")), F.col("anio").cast("string"), F.lit("26.50"), F.col("anom").cast("string")
    )
    kinds = F.when(F.col("mes") == 1, F.array(F.lit(" SEAS  YR   TOTAL   ANOM"), line, F.lit("fin de anio")))
    rows = A.monthly_index(spark, d).select(F.explode(kinds.otherwise(F.array(line))).alias("value"))
    path = new_path(spark, "indice")
    rows.write.text(path)
    return climate_index.read(spark, path)


@check(
    "S6_table_dump",
    "SELECT region, evento, anio, semana, clasificacion, conteo, fuente FROM facts",
)
def s6(spark, d):
    fact = A.facts(spark, d)
    line = F.concat_ws("\t", F.xxhash64(*fact.columns), "region", "evento", "anio", "semana", "clasificacion", "conteo", "fuente")
    weeks = A.calendar(spark, d).select(F.lit(1).alias("o"), F.concat_ws("\t", "anio", "semana", "fecha_inicio", "fecha_fin").alias("value"))
    body = fact.select(F.lit(4).alias("o"), line.alias("value"))
    fixed = [
        (0, "COPY public.semanas_epidemiologicas (anio, semana_epi, fecha_inicio, fecha_fin) FROM stdin;"),
        (2, r"\."),
        (3, "COPY public.casos_epidemiologicos (id, region_id, tipo_evento_id, anio, semana_epi, clasificacion, conteo, fuente_id) FROM stdin;"),
        (5, r"\."),
        (6, "-- end"),
    ]
    dump = spark.createDataFrame(fixed, "o int, value string").unionByName(weeks).unionByName(body)
    path = new_path(spark, "volcado")
    dump.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.text(path)
    return sql_dump.table(
        sql_dump.lines(spark, path),
        "casos_epidemiologicos",
        {
            "region": (1, "int"), "evento": (2, "string"), "anio": (3, "int"), "semana": (4, "int"),
            "clasificacion": (5, "string"), "conteo": (6, "bigint"), "fuente": (7, "string"),
        },
    )


@check(
    "S8_table_scan",
    """SELECT clasificacion, fuente, anio, sum(conteo)::BIGINT AS conteo FROM facts
    WHERE anio IN (1999, 2000) AND clasificacion IN ('probable', 'confirmado') GROUP BY ALL""",
)
def s8(spark, d):
    path = new_path(spark, "hechos")
    writers.facts(A.facts(spark, d), path)
    keep = F.col("anio").isin(1999, 2000) & F.col("clasificacion").isin("probable", "confirmado")
    stored = spark.read.parquet(path).filter(keep).select("clasificacion", "fuente", "anio", "conteo")
    return stored.groupBy("clasificacion", "fuente", "anio").agg(F.sum("conteo").alias("conteo"))


@check(
    "S9_interim_csv",
    f"""SELECT anio, semana, valor AS casos, n_obs, anios_presentes, corte_inferior, corte_superior, etiqueta, {', '.join(NAMES)}
    FROM dataset WHERE motivo IS NULL""",
)
def s9(spark, d):
    rows = training_rows(spark, d).filter(F.col("motivo").isNull()).withColumnRenamed("valor", "casos")
    path = new_path(spark, "dataset")
    fixed = ["anio int", "semana int", "casos double", "n_obs bigint", "anios_presentes bigint", "corte_inferior double", "corte_superior double", "etiqueta string"]
    schema = ", ".join(fixed + [f"{n} double" for n in NAMES])
    writers.csv(rows.select(*[c.split()[0] for c in fixed], *NAMES), path)
    return tables.interim(spark, path, schema)


@check(
    "S10_dimension_load",
    """SELECT n_name AS codigo, regiones.nombre, 1 AS nivel_admin, 'XX' AS pais, r_name AS padre, lower(r_name) AS padre_nombre
    FROM nation JOIN region ON n_regionkey = r_regionkey JOIN regiones ON region = n_nationkey
    UNION ALL SELECT r_name, lower(r_name), 0, 'XX', NULL, NULL FROM region""",
)
def s10(spark, d):
    top = A.table(spark, d, "region").select(
        F.col("r_name").alias("codigo"), F.lower("r_name").alias("nombre"), F.lit(0).alias("nivel_admin"),
        F.lit("XX").alias("pais"), F.lit(None).cast("string").alias("padre"),
    )
    low = A.regions(spark, d).select("codigo", "nombre", "nivel_admin", F.lit("XX").alias("pais"), "padre")
    path = new_path(spark, "regiones")
    writers.csv(top.unionByName(low), path)
    return tables.regions(spark, path)


@check(
    "K3_audit_log",
    """SELECT archivo, anio, version, CASE WHEN semana % 2 = 0 OR anio = 2001 THEN 'ok' ELSE 'pendiente' END AS estado,
        CAST('0x' || md5(archivo)[1:15] AS BIGINT) AS boletin_id FROM archivos""",
)
def k3(spark, d):
    rows = bulletin_files_of(spark, d)
    even = (F.col("semana_archivo").cast("int") % 2 == 0) | (F.col("anio") == 2001)
    known = ["archivo", "anio", "version"]
    log = rows.filter(F.col("anio") < 2001).select(*known, F.lit("pendiente").alias("estado"))
    batch = rows.filter(even).select(*known, F.lit("ok").alias("estado"))
    return upsert.audit_log(log, batch)


@check(
    "K5_csv_results",
    "SELECT anio, semana, valor, n_obs, suficiente, p50, p75, p90, clase_p75_p90 FROM canal",
)
def k5(spark, d):
    cells = channel.endemic_channel(national(spark, d), [], A.BASE_YEARS)
    path = new_path(spark, "canal")
    writers.csv(cells.select("anio", "semana", "valor", "n_obs", "suficiente", "p50", "p75", "p90", "clase_p75_p90"), path)
    schema = "anio int, semana int, valor double, n_obs bigint, suficiente boolean, p50 double, p75 double, p90 double, clase_p75_p90 string"
    return tables.interim(spark, path, schema)


@check(
    "X5_number_tokens",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 4 THEN CAST(l_quantity AS INTEGER) + (l_orderkey % 10) / 10.0::DOUBLE
        WHEN 3 THEN floor(l_extendedprice) * 1000 ELSE floor(l_extendedprice) END AS numero FROM lineitem""",
)
def x5(spark, d):
    whole = F.floor("l_extendedprice")
    comma = F.format_number(whole, 0)
    lost = F.regexp_replace(F.format_number(whole * 1000, 0), r"^(\d+),(\d{3},)", "$1$2")
    decimal = F.concat_ws(".", F.col("l_quantity").cast("int").cast("string"), (F.col("l_orderkey") % 10).cast("string"))
    kind = F.col("l_linenumber") % 5
    token = (
        F.when(kind == 0, comma)
        .when(kind == 1, F.replace(comma, F.lit(","), F.lit(".")))
        .when(kind == 2, whole.cast("string"))
        .when(kind == 3, lost)
        .otherwise(F.when(F.col("l_orderkey") % 2 == 0, decimal).otherwise(F.replace(decimal, F.lit("."), F.lit(","))))
    )
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.number(token).alias("numero"))


@check(
    "X7_place_keys",
    "SELECT anio, lower(strip_accents(nombre)) AS clave, sum(conteo)::BIGINT AS conteo FROM facts JOIN regiones USING (region) GROUP BY ALL",
)
def x7(spark, d):
    return A.reported_names(spark, d).select("anio", text.place_key(F.col("lugar")).alias("clave"), "conteo")


@check(
    "K8_source_fingerprints",
    """SELECT anio, sha256(string_agg(semana || ',' || conteo || chr(10), '' ORDER BY semana)) AS sha256
    FROM obs_nat GROUP BY anio""",
)
def k8(spark, d):
    """One source file per year, fingerprinted as the gate does."""
    path = new_path(spark, "fuentes")
    lines = A.obs_national(spark, d).select("anio", "semana", F.concat_ws(",", "semana", "conteo").alias("value"))
    ordered = lines.repartition("anio").sortWithinPartitions("anio", "semana").drop("semana")
    ordered.write.partitionBy("anio").text(path)
    found = writers.fingerprints(spark, path)
    return found.select(F.regexp_extract("carpeta", r"anio=(\d+)", 1).cast("int").alias("anio"), "sha256")

"""The whole rule set over broken tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check
from checks.bulletins import lab_pages
from checks.weather import weekly_long
from weekwatch.operators import integrity
from weekwatch.plans import adapters as A


@check(
    "K6_constraint_rules",
    """SELECT 'clima_clave_unica' AS regla, region || '|' || anio || '|' || semana || '|' || variable || '|era5' AS clave, 2::BIGINT AS filas FROM semanal
    WHERE anio = 1996 AND semana = 5 AND variable = 'temp_max'
    UNION ALL SELECT 'clima_fk_calendario', anio || '|' || semana, sum(CASE WHEN anio = 1996 AND semana = 5 AND variable = 'temp_max' THEN 2 ELSE 1 END)::BIGINT FROM semanal
    WHERE NOT EXISTS (FROM cal c WHERE c.anio = semanal.anio AND c.semana = semanal.semana AND NOT (c.anio = 1995 AND c.semana = 10)) GROUP BY ALL
    UNION ALL SELECT 'clima_fk_fuente', 'desconocida', 1
    UNION ALL SELECT 'clima_valor_nulo', '1|1996|6|nueva|desconocida', 1
    UNION ALL SELECT 'calendario_continuo', CAST(fecha_inicio AS VARCHAR), 1 FROM cal WHERE anio = 1995 AND semana = 10
    UNION ALL SELECT 'bitacora_estado', archivo, 1 FROM lab_docs WHERE semana = 7 AND version = 1
    UNION ALL SELECT 'bitacora_familia', archivo, 1 FROM lab_docs WHERE semana = 8 AND version = 1
    UNION ALL SELECT 'bitacora_obligatorios', archivo || '||ok', 1 FROM lab_docs WHERE semana = 9 AND version = 1
    UNION ALL SELECT 'region_padre', r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL""",
)
def k6_rules(spark, d):
    """Weather with a doubled week and a stray row, a calendar without one week, a log with bad values, a lost parent."""
    weather = weekly_long(spark, d).withColumn("fuente", F.lit("era5"))
    twice = weather.filter("anio = 1996 AND semana = 5 AND variable = 'temp_max'")
    stray = spark.range(1).select(
        F.lit(1).alias("region"), F.lit(1996).alias("anio"), F.lit(6).alias("semana"), F.lit("nueva").alias("variable"),
        F.lit(None).cast("decimal(10,3)").alias("valor"), F.lit("desconocida").alias("fuente"))
    weeks = integrity.with_successor(A.calendar(spark, d)).filter("NOT (anio = 1995 AND semana = 10)")
    week = F.col("semana_archivo").cast("int")
    first = F.col("version") == 1
    log = lab_pages(spark, d).select("archivo", "anio", "semana_archivo", "version").distinct().select(
        "archivo", F.when(~(first & (week == 9)), F.col("anio")).alias("anio"),
        F.when(first & (week == 7), "leido").otherwise("ok").alias("estado"), F.when(first & (week == 8), "C").when(week % 2 == 0, "A").alias("familia"))
    parents = A.table(spark, d, "region").filter("r_name <> 'ASIA'").select(
        F.lit(None).cast("int").alias("region"), F.col("r_name").alias("codigo"), F.col("r_name").alias("nombre"), F.lit(0).alias("nivel_admin"), F.lit(None).cast("string").alias("padre"))
    regions = A.regions(spark, d).withColumn("region", F.col("region").cast("int")).unionByName(parents)
    sources = spark.range(1).select(F.lit("era5").alias("fuente"))
    return integrity.violations({
        "clima": weather.unionByName(twice).unionByName(stray), "calendario": weeks, "bitacora": log, "regiones": regions, "fuentes": sources})

"""Surveillance-shaped views over the driver's star-schema tables.

The library itself works on any table with these shapes; these views exist so
that every operator can be checked on data of any scale. Facts are
pre-aggregated on their own key before the join that adds the region, so a key
that holds a third of the rows shrinks on the map side and never reaches one
task as raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekwatch.functions import calendar as cal
from weekwatch.functions.text import strip_accents
from weekwatch.operators import calendar as calendar_ops

BASE_YEARS = (1995, 1996, 1997, 1999, 2000)
EXCLUDED_YEAR = 1998
VARIABLES = (
    "temp_max",
    "temp_min",
    "temp_media",
    "humedad_relativa_media",
    "punto_rocio",
    "precipitation_sum",
    "precipitation_hours",
)
ACCUMULATIVE = ("precipitation_sum", "precipitation_hours")


Ranges = Sequence[tuple[date, date]]


def table(spark: SparkSession, sf_dir: str, name: str, day: str | None = None, ranges: Ranges | None = None) -> DataFrame:
    """A driver table; with ``ranges`` only the rows whose ``day`` lies in them, cut at the scan."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if ranges is None else rows.filter(cal.in_ranges(F.col(day), ranges))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of all years that orders cover."""
    start = cal.week_start(F.col("o_orderdate").cast("date"))
    bounds = table(spark, sf_dir, "orders").agg(
        F.min(cal.mmwr_year(start)).alias("anio_min"), F.max(cal.mmwr_year(start)).alias("anio_max")
    )
    return calendar_ops.generate(bounds)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region dimension: nations as level 1 under their level-0 parent."""
    key = F.col("n_nationkey")
    suffix = F.concat(F.char(F.lit(65) + F.floor(key / 26)), F.char(F.lit(65) + key % 26))
    parent = F.replace(F.initcap("r_name"), F.lit("A"), F.lit("Á"))
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("region"),
            F.col("n_name").alias("codigo"),
            F.concat_ws(" ", parent, suffix).alias("nombre"),
            F.lit(1).alias("nivel_admin"),
            F.col("r_name").alias("padre"),
        )
    )


def status_class(status: Column) -> Column:
    return (
        F.when(status == "F", "confirmado").when(status == "O", "probable").when(status == "P", "notificado")
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case fact: count per region, class and week."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        status_class(F.col("o_orderstatus")).alias("clase"),
        cal.week_start(F.col("o_orderdate").cast("date")).alias("fecha"),
    )
    per_customer = orders.groupBy("o_custkey", "fecha", "clase").agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region")
    )
    return (
        per_customer.join(customers, "o_custkey")
        .groupBy("region", "clase", "fecha")
        .agg(F.sum("n").alias("conteo"))
        .select(
            "region",
            "clase",
            cal.mmwr_year(F.col("fecha")).alias("anio"),
            cal.mmwr_week(F.col("fecha")).alias("semana"),
            "fecha",
            "conteo",
        )
    )


def obs_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National total per week; needs no region, so orders are read alone."""
    start = cal.week_start(F.col("o_orderdate").cast("date"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(start.alias("fecha"))
        .agg(F.count(F.lit(1)).alias("conteo"))
        .select(
            cal.mmwr_year(F.col("fecha")).alias("anio"),
            cal.mmwr_week(F.col("fecha")).alias("semana"),
            "fecha",
            "conteo",
        )
    )


def daily_wide(spark: SparkSession, sf_dir: str, ranges: Ranges | None = None) -> DataFrame:
    """Daily weather per region, one column per variable, in thousandths (bigint).

    Rain is null on one day in eleven while its hours still carry a value, which
    is the false-zero case of the weather source.
    """
    per_supplier = (
        table(spark, sf_dir, "lineitem", "l_shipdate", ranges)
        .groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("fecha"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(_cents("l_quantity")).alias("q"),
            F.max(_cents("l_quantity")).alias("q_max"),
            F.min(_cents("l_quantity")).alias("q_min"),
            F.sum(_cents("l_discount")).alias("d"),
            F.sum(_cents("l_extendedprice")).alias("e"),
        )
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("region")
    )
    sums = (
        per_supplier.join(suppliers, "l_suppkey")
        .groupBy("region", "fecha")
        .agg(
            F.sum("n").alias("n"),
            F.sum("q").alias("q"),
            F.max("q_max").alias("q_max"),
            F.min("q_min").alias("q_min"),
            F.sum("d").alias("d"),
            F.sum("e").alias("e"),
        )
    )
    missing_rain = (F.col("region") + F.dayofyear("fecha")) % 11 == 0
    return sums.select(
        "region",
        "fecha",
        F.expr("16000 + (22000 * q_max) div 5000").alias("temp_max"),
        F.expr("16000 + (22000 * q_min) div 5000").alias("temp_min"),
        F.expr("16000 + (22000 * q) div (5000 * n)").alias("temp_media"),
        F.expr("40000 + (5000 * d) div n").alias("humedad_relativa_media"),
        F.expr("16000 + (22000 * q) div (5000 * n) - (60000 - (5000 * d) div n) div 5").alias("punto_rocio"),
        F.when(~missing_rain, F.expr("e div 1000")).alias("precipitation_sum"),
        F.expr("1000 * n").alias("precipitation_hours"),
    )


def _cents(amount: str) -> Column:
    """Whole cents, so that sums are exact, order-free and stay in compiled long arithmetic."""
    return F.rint(F.col(amount) * 100).cast("bigint")


def milli(value: Column) -> Column:
    """Stored weather value decimal(10,3) of an integer number of thousandths."""
    return (value.cast("decimal(13,0)") / 1000).cast("decimal(10,3)")


def daily_payload(spark: SparkSession, sf_dir: str, ranges: Ranges | None = None) -> DataFrame:
    """Daily weather wide with stored types."""
    wide = daily_wide(spark, sf_dir, ranges)
    return wide.select("region", "fecha", *[milli(F.col(v)).alias(v) for v in VARIABLES])


def monthly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly climate index derived from the number of orders per month."""
    day = F.col("o_orderdate").cast("date")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.year(day).alias("anio"), F.month(day).alias("mes"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("anio", "mes", ((F.col("n") % 41 - 20) / F.lit(10.0)).alias("anom"))
    )


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters per region, class, year and cut week, with the usual defects.

    Weeks divisible by 6 are missing, some counters are corrected downwards, some
    weeks reprint the previous cut and some have a superseded first version.
    """
    years = obs(spark, sf_dir).groupBy("region", "clase", "anio").agg(
        F.map_from_entries(F.collect_list(F.struct("semana", "conteo"))).alias("conteos")
    )
    weeks = years.select("region", "clase", "anio", "conteos", F.explode(F.sequence(F.lit(1), F.lit(52))).alias("semana"))
    year = Window.partitionBy("region", "clase", "anio").orderBy("semana")
    running = (
        weeks.withColumn("conteo", F.coalesce(F.try_element_at("conteos", "semana"), F.lit(0)))
        .withColumn("suma", F.sum("conteo").over(year))
        .drop("conteos")
        .filter(F.col("semana") % 6 != 0)
        .withColumn(
            "acum",
            F.greatest(
                F.col("suma")
                - F.when((F.col("region") + F.col("semana")) % 11 == 0, F.lit(2)).otherwise(F.lit(0)),
                F.lit(0),
            ),
        )
        .withColumn("previo", F.lag("acum").over(year))
        .withColumn(
            "acum",
            F.when(F.col("semana") % 17 == 9, F.coalesce("previo", "acum")).otherwise(F.col("acum")),
        )
    )
    versions = F.when(F.col("semana") % 4 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    versioned = running.select("region", "clase", "anio", "semana", "acum", F.explode(versions).alias("version"))
    superseded = (F.col("semana") % 4 == 1) & (F.col("version") == 1)
    return versioned.select(
        "region",
        "clase",
        "anio",
        "semana",
        "version",
        F.when(superseded, F.greatest(F.col("acum") - 1, F.lit(0))).otherwise(F.col("acum")).alias("acum"),
        file_name(F.col("anio"), F.col("semana"), F.col("version")).alias("archivo"),
    )


def file_name(year: Column, week: Column, version: Column) -> Column:
    suffix = F.when(version > 1, F.concat(F.lit("_v"), version.cast("string"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("Boletin_SE"),
        F.lpad(week.cast("string"), 2, "0"),
        year.cast("string"),
        suffix,
        F.lit(".pdf"),
    )


def facts(spark: SparkSession, sf_dir: str, ranges: Ranges | None = None) -> DataFrame:
    """Case fact with event and source: the natural key of the case table."""
    orders = table(spark, sf_dir, "orders", "o_orderdate", ranges).select(
        "o_custkey",
        status_class(F.col("o_orderstatus")).alias("clasificacion"),
        F.col("o_orderpriority").alias("fuente"),
        cal.week_start(F.col("o_orderdate").cast("date")).alias("fecha"),
    )
    per_customer = orders.groupBy("o_custkey", "fecha", "clasificacion", "fuente").agg(
        F.count(F.lit(1)).alias("n")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region")
    )
    return (
        per_customer.join(customers, "o_custkey")
        .groupBy("region", "clasificacion", "fuente", "fecha")
        .agg(F.sum("n").alias("conteo"))
        .select(
            "region",
            F.when(F.col("clasificacion") == "notificado", "ira").otherwise("dengue").alias("evento"),
            cal.mmwr_year(F.col("fecha")).alias("anio"),
            cal.mmwr_week(F.col("fecha")).alias("semana"),
            "clasificacion",
            "fuente",
            "fecha",
            "conteo",
        )
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source dimension: the distinct sources facts come from."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("fuente")).distinct()


def reported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals per place name as differently spelled in each year."""
    named = facts(spark, sf_dir).join(regions(spark, sf_dir).select("region", "nombre"), "region")
    spelled = (
        F.when(F.col("anio") % 3 == 0, F.concat(F.lit("Departamento de "), F.col("nombre")))
        .when(F.col("anio") % 3 == 1, F.concat(F.lit("  "), F.upper(strip_accents(F.col("nombre")))))
        .otherwise(F.replace("nombre", F.lit(" "), F.lit("   ")))
    )
    return named.groupBy("anio", spelled.alias("lugar")).agg(F.sum("conteo").alias("conteo"))

"""Registry of checked queries and the SQL views their oracles share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE_YEARS = "(1995, 1996, 1997, 1999, 2000)"

# name -> body; a body may use any view defined before it.
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    if name in VIEWS:
        raise ValueError(f"view {name} defined twice")
    VIEWS[name] = body


def with_views(body: str) -> str:
    """Prefix ``body`` with the shared views it uses, directly or through others."""
    names = list(VIEWS)
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in names:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(VIEWS[name])
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names if n in needed)
    if not ctes:
        return body
    return f"WITH {ctes}\n{body}" if not body.lstrip().upper().startswith("WITH ") else (
        f"WITH {ctes},\n{body.lstrip()[5:]}"
    )


def observed(spark: SparkSession, seen) -> DataFrame:
    """What an observation received, as one row."""
    return spark.createDataFrame([tuple(seen.get.values())], ", ".join(f"{name} long" for name in seen.get))


def check(name: str, sql: str | None = None):
    """Register a query, with its oracle when one can be written."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def pct(values: str, p: float) -> str:
    """Inclusive linear percentile of an ascending list, in SQL."""
    pos = f"({p}::DOUBLE * (len({values}) - 1))"
    low = f"CAST(floor({pos}) AS BIGINT)"
    a = f"{values}[{low} + 1]"
    b = f"{values}[least({low} + 2, len({values}))]"
    return f"(CASE WHEN len({values}) = 1 THEN {values}[1] ELSE {a} + ({pos} - {low}) * ({b} - {a}) END)"


def median(values: str) -> str:
    n = f"len({values})"
    return (
        f"(CASE WHEN {n} % 2 = 1 THEN {values}[({n} + 1) // 2] "
        f"ELSE ({values}[{n} // 2] + {values}[{n} // 2 + 1]) / 2 END)"
    )


def classes(value: str, low: str, high: str, names: tuple[str, str, str] = ("bajo", "medio", "alto")) -> str:
    return (
        f"(CASE WHEN {value} > {high} THEN '{names[2]}' WHEN {value} > {low} THEN '{names[1]}' "
        f"WHEN {high} IS NOT NULL AND {value} IS NOT NULL THEN '{names[0]}' END)"
    )


def week_start(ts: str) -> str:
    return f"(CAST({ts} AS DATE) - CAST(dayofweek({ts}) AS INTEGER))"


def mmwr(start: str) -> tuple[str, str]:
    year = f"CAST(year({start} + 3) AS INTEGER)"
    week = f"CAST((dayofyear({start} + 3) - 1) // 7 + 1 AS INTEGER)"
    return year, week


_Y, _W = mmwr("fecha")

view(
    "cal_bounds",
    f"SELECT min({mmwr('f')[0]}) AS y0, max({mmwr('f')[0]}) AS y1 "
    f"FROM (SELECT {week_start('o_orderdate')} AS f FROM orders)",
)
view(
    "cal",
    f"""SELECT {_Y} AS anio, {_W} AS semana, fecha AS fecha_inicio, fecha + 6 AS fecha_fin
    FROM (SELECT CAST(unnest(generate_series(
            {week_start("make_date(y0, 1, 4)")}::TIMESTAMP,
            ({week_start("make_date(y1 + 1, 1, 4)")} - 7)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS fecha
          FROM cal_bounds)""",
)
view(
    "regiones",
    """SELECT n_nationkey AS region, n_name AS codigo,
        replace(array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(r_name, ' ')], ' '), 'A', 'Á') || ' ' ||
            chr(CAST(65 + n_nationkey // 26 AS INTEGER)) || chr(CAST(65 + n_nationkey % 26 AS INTEGER)) AS nombre,
        1 AS nivel_admin, r_name AS padre
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
view(
    "obs",
    f"""SELECT region, clase, {_Y} AS anio, {_W} AS semana, fecha, count(*) AS conteo
    FROM (SELECT c_nationkey AS region, {week_start("o_orderdate")} AS fecha,
            CASE o_orderstatus WHEN 'F' THEN 'confirmado' WHEN 'O' THEN 'probable' WHEN 'P' THEN 'notificado' END AS clase
          FROM orders JOIN customer ON o_custkey = c_custkey)
    GROUP BY ALL""",
)
view(
    "obs_nat",
    f"""SELECT {_Y} AS anio, {_W} AS semana, fecha, count(*) AS conteo
    FROM (SELECT {week_start("o_orderdate")} AS fecha FROM orders) GROUP BY ALL""",
)
view(
    "daily_sums",
    """SELECT s_nationkey AS region, CAST(l_shipdate AS DATE) AS fecha, count(*) AS n,
        CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) * 100 AS BIGINT) AS q,
        CAST(max(CAST(l_quantity AS DECIMAL(12,2))) * 100 AS BIGINT) AS q_max,
        CAST(min(CAST(l_quantity AS DECIMAL(12,2))) * 100 AS BIGINT) AS q_min,
        CAST(sum(CAST(l_discount AS DECIMAL(12,2))) * 100 AS BIGINT) AS d,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) * 100 AS BIGINT) AS e
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
)
view(
    "daily",
    """SELECT region, fecha,
        16000 + (22000 * q_max) // 5000 AS temp_max,
        16000 + (22000 * q_min) // 5000 AS temp_min,
        16000 + (22000 * q) // (5000 * n) AS temp_media,
        40000 + (5000 * d) // n AS humedad_relativa_media,
        16000 + (22000 * q) // (5000 * n) - (60000 - (5000 * d) // n) // 5 AS punto_rocio,
        CASE WHEN (region + dayofyear(fecha)) % 11 <> 0 THEN e // 1000 END AS precipitation_sum,
        1000 * n AS precipitation_hours
    FROM daily_sums""",
)
view(
    "idx",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS anio, CAST(month(o_orderdate) AS INTEGER) AS mes,
        (count(*) % 41 - 20) / 10.0::DOUBLE AS anom
    FROM orders GROUP BY 1, 2""",
)
view(
    "cuts_grid",
    """SELECT region, clase, anio, CAST(semana AS INTEGER) AS semana,
        sum(coalesce(conteo, 0)) OVER (PARTITION BY region, clase, anio ORDER BY semana) AS suma
    FROM (SELECT region, clase, anio, unnest(generate_series(1, 52)) AS semana
          FROM (SELECT DISTINCT region, clase, anio FROM obs))
    LEFT JOIN (SELECT region, clase, anio, semana, conteo FROM obs) USING (region, clase, anio, semana)""",
)
view(
    "cuts_one",
    """SELECT region, clase, anio, semana,
        CASE WHEN semana % 17 = 9 THEN coalesce(lag(acum) OVER w, acum) ELSE acum END AS acum
    FROM (SELECT *, greatest(suma - CASE WHEN (region + semana) % 11 = 0 THEN 2 ELSE 0 END, 0) AS acum
          FROM cuts_grid WHERE semana % 6 <> 0)
    WINDOW w AS (PARTITION BY region, clase, anio ORDER BY semana)""",
)
view(
    "cuts",
    """SELECT region, clase, anio, semana, version,
        CAST(CASE WHEN semana % 4 = 1 AND version = 1 THEN greatest(acum - 1, 0) ELSE acum END AS BIGINT) AS acum,
        'Boletin_SE' || lpad(CAST(semana AS VARCHAR), 2, '0') || anio ||
            CASE WHEN version > 1 THEN '_v' || version ELSE '' END || '.pdf' AS archivo
    FROM (SELECT *, CAST(unnest(CASE WHEN semana % 4 = 1 THEN [1, 2] ELSE [1] END) AS INTEGER) AS version
          FROM cuts_one)""",
)


def history(series: str, keys: str, window: int, rule: str) -> str:
    """Theta self-join of a series with its own history: one row per observed cell.

    ``rule`` compares target ``t`` with history row ``h``.
    """
    on = " AND ".join(f"h.{k} = t.{k}" for k in keys.split(", ")) if keys else "TRUE"
    out = ", ".join(f"t.{k}" for k in keys.split(", ")) + ", " if keys else ""
    return f"""SELECT {out}t.anio, t.semana, t.valor,
        list(h.valor ORDER BY h.valor) FILTER (h.valor IS NOT NULL) AS pool,
        count(h.valor) AS n_obs, count(DISTINCT h.anio) AS anios_presentes
    FROM {series} t LEFT JOIN {series} h
      ON {on} AND h.semana BETWEEN t.semana - {window} AND t.semana + {window} AND {rule}
    GROUP BY ALL"""


LOO = f"h.anio <> t.anio AND h.anio IN {BASE_YEARS}"

view("serie_reg", "SELECT region, clase, anio, semana, CAST(conteo AS DOUBLE) AS valor FROM obs")
view("serie_nat", "SELECT anio, semana, CAST(conteo AS DOUBLE) AS valor FROM obs_nat")
view("hist_reg", history("serie_reg", "region, clase", 1, LOO))
view("hist_nat", history("serie_nat", "", 1, LOO))

"""Constraint suite: a table of rules, checked in one pass over each table, gives the rows that break one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domains the schema admits.
CLASSIFICATIONS = ("probable", "confirmado", "total", "notificado")
STATES = ("pendiente", "ok", "revision_manual", "error", "ausencia_esperada", "sin_texto_extraible")
FAMILIES = ("A", "B")

NATURAL_KEY = ("region", "evento", "anio", "semana", "clasificacion", "fuente")
WEATHER_KEY = ("region", "anio", "semana", "variable", "fuente")


@dataclass(frozen=True)
class Rule:
    """A constraint. ``key`` names the offending rows in the report.

    ``unique``: a key occurs once. ``check``: ``predicate`` is not false. ``foreign``: the key, where it has no null, is in
    ``columns`` (the key's own names by default) of ``reference``. ``required``: no column of the key is null.
    """

    name: str
    table: str
    kind: str
    key: tuple[str, ...]
    predicate: str = ""
    reference: str = ""
    columns: tuple[str, ...] = ()


def _one_of(column: str, values: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


#: The rules of the schema. ``calendario`` needs ``siguiente``, the first day of the week after, where one must exist.
RULES = (
    Rule("clave_unica", "casos", "unique", NATURAL_KEY),
    Rule("dominio_clasificacion", "casos", "check", NATURAL_KEY, _one_of("clasificacion", CLASSIFICATIONS)),
    Rule("conteo_negativo", "casos", "check", NATURAL_KEY, "conteo >= 0"),
    Rule("semana_fuera_de_rango", "casos", "check", NATURAL_KEY, "semana BETWEEN 1 AND 53"),
    Rule("fk_calendario", "casos", "foreign", ("anio", "semana"), reference="calendario"),
    Rule("fk_region", "casos", "foreign", ("region",), reference="regiones"),
    Rule("fk_fuente", "casos", "foreign", ("fuente",), reference="fuentes"),
    Rule("clima_clave_unica", "clima", "unique", WEATHER_KEY),
    Rule("clima_valor_nulo", "clima", "check", WEATHER_KEY, "valor IS NOT NULL"),
    Rule("clima_fk_calendario", "clima", "foreign", ("anio", "semana"), reference="calendario"),
    Rule("clima_fk_region", "clima", "foreign", ("region",), reference="regiones"),
    Rule("clima_fk_fuente", "clima", "foreign", ("fuente",), reference="fuentes"),
    Rule("calendario_clave_unica", "calendario", "unique", ("anio", "semana")),
    Rule("calendario_semana", "calendario", "check", ("anio", "semana"), "semana BETWEEN 1 AND 53"),
    Rule("calendario_siete_dias", "calendario", "check", ("anio", "semana"), "datediff(fecha_fin, fecha_inicio) = 6"),
    Rule("calendario_continuo", "calendario", "foreign", ("siguiente",), reference="calendario", columns=("fecha_inicio",)),
    Rule("bitacora_clave_unica", "bitacora", "unique", ("archivo",)),
    Rule("bitacora_estado", "bitacora", "check", ("archivo",), _one_of("estado", STATES)),
    Rule("bitacora_familia", "bitacora", "check", ("archivo",), _one_of("familia", FAMILIES)),
    Rule("bitacora_obligatorios", "bitacora", "required", ("archivo", "anio", "estado")),
    Rule("region_codigo_unico", "regiones", "unique", ("codigo",)),
    Rule("region_obligatorios", "regiones", "required", ("codigo", "nombre", "nivel_admin")),
    Rule("region_padre", "regiones", "foreign", ("padre",), reference="regiones", columns=("codigo",)),
)


def with_successor(calendar: DataFrame) -> DataFrame:
    """Calendar with the first day of the week after; the last week needs none."""
    last = calendar.agg(F.max("fecha_inicio")).scalar()
    return calendar.withColumn("siguiente", F.when(F.col("fecha_inicio") < last, F.date_add("fecha_inicio", 7)))


def _text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def violations(tables: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rule, offending key and number of rows for every broken rule whose tables are given."""
    parts = []
    for name, table in tables.items():
        own = [r for r in rules if r.table == name and (not r.reference or r.reference in tables)]
        if own:
            parts.append(_broken(table, own, tables))
    if not parts:
        raise ValueError("no rule has its tables")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _broken(table: DataFrame, rules: Sequence[Rule], tables: Mapping[str, DataFrame]) -> DataFrame:
    """The table collapses to its keys on the map side, with the rows that fail each check; references flag the keys they
    know; then each key lists what it breaks. Keys of unique rules are added up and kept where they are repeated."""
    keys = list(dict.fromkeys(c for r in rules for c in r.key))
    failed = {r.name: F.count_if(~F.coalesce(F.expr(r.predicate), F.lit(True))) for r in rules if r.kind == "check"}
    keyed = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_{n}") for n, c in failed.items()])
    found = []
    for r in rules:
        if r.kind == "foreign":
            there = tables[r.reference].select(*[F.col(c).alias(k) for c, k in zip(r.columns or r.key, r.key)]).dropna().distinct()
            keyed = keyed.join(there.withColumn(f"_{r.name}", F.lit(True)), list(r.key), "left")
            missing = F.col(f"_{r.name}").isNull()
            for k in r.key:
                missing = missing & F.col(k).isNotNull()
            rows = F.when(missing, F.col("_n"))
        elif r.kind == "unique":
            rows = F.when(F.col("_n") > 1, F.col("_n")) if set(r.key) == set(keys) else F.col("_n")
        elif r.kind == "required":
            absent = F.lit(False)
            for k in r.key:
                absent = absent | F.col(k).isNull()
            rows = F.when(absent, F.col("_n"))
        else:
            rows = F.when(F.col(f"_{r.name}") > 0, F.col(f"_{r.name}"))
        found.append(F.when(rows.isNotNull(), F.struct(
            F.lit(r.name).alias("regla"), _text(r.key).alias("clave"), rows.alias("filas"), F.lit(r.kind == "unique").alias("unica"))))
    sums = keyed.select(F.explode(F.array_compact(F.array(*found))).alias("v")).groupBy("v.regla", "v.clave", "v.unica").agg(F.sum("v.filas").alias("filas"))
    return sums.filter(~F.col("unica") | (F.col("filas") > 1)).select("regla", "clave", "filas")


def case_fact_violations(fact: DataFrame, calendar: DataFrame, regions: DataFrame, sources: DataFrame) -> DataFrame:
    """What breaks the rules of the case fact."""
    tables = {"casos": fact, "calendario": calendar, "regiones": regions, "fuentes": sources}
    return violations(tables, [r for r in RULES if r.table == "casos"])

"""The single-series event from bulletin pages to fact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.operators import bulletins_notified as N
from weekwatch.operators import contracts, cumulative, upsert
from weekwatch.operators.integrity import NATURAL_KEY
from weekwatch.session import stored

# How the event's rows are classified.
CLASS = "notificado"


def documents_and_rows(pages: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current documents with their final states, repeated tables up for review, and the regional rows of all tables."""
    documents, found = N.analyse(pages, names)
    found = stored(found)
    return N.review_reprints(stored(N.current(documents)), found), found


def weekly_points(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Weekly points of usable documents; first cuts that span weeks, gaps and corrections carry a note."""
    counters = cumulative.last_cut_wins(N.cuts(documents, found), ["region"])
    return cumulative.deaccumulate(counters, ["region"])


def fact_rows(points: DataFrame, regions: DataFrame, event: str, source: str) -> DataFrame:
    """Fact rows of the points without a note; aborts when a region is not in the catalogue."""
    safe = contracts.matched(cumulative.safe_points(points), regions.select("region"), ["region"], "region without catalogue entry")
    return cumulative.case_rows(safe).select(
        "region", F.lit(event).alias("evento"), "anio", "semana", F.lit(CLASS).alias("clasificacion"), F.lit(source).alias("fuente"), "conteo")


def load(fact: DataFrame, rows: DataFrame) -> DataFrame:
    """The fact after the rows were written over it on their natural key; a second load changes nothing."""
    return upsert.upsert(fact.select(*rows.columns), rows, NATURAL_KEY)


def load_report(points: DataFrame) -> DataFrame:
    """One row: points read, safe ones, and those left out by reason."""
    return points.agg(
        F.count(F.lit(1)).alias("leidas"),
        F.count_if(F.trim("nota") == "").alias("insertadas"),
        *[F.count_if(F.col("tipo") == kind).alias(name) for kind, name in
          (("primer_corte", "primeros_cortes"), ("hueco", "huecos"), ("correccion", "correcciones"))],
    )

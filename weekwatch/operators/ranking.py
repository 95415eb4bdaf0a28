"""Cumulative sums over a whole column without sorting it in one task.

Values are cut into ranges by approximate quantiles, ranges are totalled, and
the exact running total inside each range is added to the total of the ranges
before it. The window over ranges sees ``MOST_RANGES`` rows per group at most; the
window over values sees one range. Equal values are summed before, so a value
shared by a third of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekwatch.session import stored

#: Values of a range, as far as ``MOST_RANGES`` ranges of a group allow it.
RANGE_VALUES, MOST_RANGES = 50_000, 512

def running_totals(
    rows: DataFrame,
    by: str,
    totals: Sequence[str],
    groups: Sequence[str] = (),
    range_values: int = RANGE_VALUES,
    descending: bool = False,
) -> DataFrame:
    """Sum ``totals`` per distinct ``by``; add what comes before it and the group total.

    New columns are ``<total>_antes`` and ``<total>_grupo``. The distinct values
    are read several times, so they are stored once. Each group has its own cuts,
    from a quantile sketch of its values, and as many ranges of about
    ``range_values`` values as it needs: a small group is one range.
    """
    distinct = stored(rows.groupBy(*groups, by).agg(*[F.sum(t).alias(t) for t in totals]))
    quantiles = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    sketch = F.struct(F.count(F.lit(1)).alias("n"), F.percentile_approx(by, quantiles, 20 * MOST_RANGES).alias("cortes"))
    # a power of two of ranges takes every 1st, 2nd, 4th, ... cut
    wanted = F.least(F.lit(float(MOST_RANGES)), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("_s.n") / range_values, F.lit(1.0))))))
    step = (F.lit(MOST_RANGES) / wanted).cast("int")
    cuts = distinct.groupBy(*groups).agg(sketch.alias("_s")).select(*groups, F.filter("_s.cortes", lambda c, i: (i + 1) % step == 0).alias("_cortes"))
    placed = distinct.join(cuts, list(groups)) if groups else distinct.withColumn("_cortes", cuts.scalar())
    place = F.size(F.filter("_cortes", lambda s: s < F.col(by)))
    ranged = placed.withColumn("_tramo", -place if descending else place).drop("_cortes")

    group = Window.partitionBy(*groups, F.lit(0)).orderBy("_tramo")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        ranged.groupBy(*groups, "_tramo")
        .agg(*[F.sum(t).alias(t) for t in totals])
        .select(
            *groups,
            "_tramo",
            *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"_{t}") for t in totals],
            *[F.sum(t).over(whole).alias(f"{t}_grupo") for t in totals],
        )
    )
    order = F.desc(by) if descending else F.asc(by)
    inside = Window.partitionBy(*groups, "_tramo").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(offsets, [*groups, "_tramo"])
    running = {
        f"{t}_antes": F.coalesce(F.sum(t).over(inside), F.lit(0)) + F.col(f"_{t}") for t in totals
    }
    return joined.withColumns(running).drop("_tramo", *[f"_{t}" for t in totals])


def exact_median(values: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Median per group as the mean of the two central values."""
    known = values.filter(F.col(column).isNotNull()).select(*groups, column, F.lit(1).alias("n"))
    ranked = running_totals(known, column, ["n"], groups)
    upper, lower = F.floor(F.col("n_grupo") / 2), F.floor((F.col("n_grupo") - 1) / 2)
    holds = lambda i: (F.col("n_antes") <= i) & (i < F.col("n_antes") + F.col("n"))
    return ranked.groupBy(*groups).agg(
        ((F.max(F.when(holds(lower), F.col(column))) + F.max(F.when(holds(upper), F.col(column)))) / 2).alias("mediana")
    )


def values_at(values: DataFrame, column: str, positions: dict[str, Column]) -> DataFrame:
    """One row: for each name the known value at a position of the ascending order (from 0, given by ``n``, their number)."""
    known = values.filter(F.col(column).isNotNull()).select(column, F.lit(1).alias("n"))
    ranked = running_totals(known, column, ["n"]).withColumnsRenamed({"n": "_aqui", "n_grupo": "n"})
    at = lambda k: (F.col("n_antes") <= k) & (k < F.col("n_antes") + F.col("_aqui"))
    return ranked.agg(*[F.max(F.when(at(k), F.col(column))).alias(name) for name, k in positions.items()])

import random
import statistics

from pyspark.sql import functions as F

from weekwatch.functions import classify, percentiles, suitability
from weekwatch.functions.text import file_version, file_week, number, place_key


def one(spark, pool, *columns):
    df = spark.createDataFrame([(sorted(map(float, pool)),)], "a array<double>")
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


A = "a"


def test_linear_percentile_literals(spark):
    pool = range(1, 13)
    assert one(spark, pool, percentiles.linear_percentile(F.col(A), 0.5), percentiles.linear_percentile(F.col(A), 0.75)) == (6.5, 9.25)
    assert one(spark, [4], percentiles.linear_percentile(F.col(A), 0.9)) == (4.0,)
    assert one(spark, [], percentiles.linear_percentile(F.col(A), 0.9), percentiles.midpoint_median(A)) == (None, None)


def test_linear_percentile_and_deviation_match_the_standard_library(spark):
    rng = random.Random(7)
    pools = [[float(rng.randint(0, 30)) for _ in range(rng.randint(2, 15))] for _ in range(60)]
    df = spark.createDataFrame([(i, sorted(p)) for i, p in enumerate(pools)], "i int, a array<double>")
    rows = df.select(
        "i",
        percentiles.linear_percentile(F.col(A), 0.25).alias("q1"),
        percentiles.linear_percentile(F.col(A), 0.75).alias("q3"),
        percentiles.midpoint_median(A).alias("m"),
        percentiles.sample_deviation(A).alias("s"),
    ).collect()
    for r in rows:
        q = statistics.quantiles(pools[r.i], n=4, method="inclusive")
        assert abs(r.q1 - q[0]) < 1e-9 and abs(r.q3 - q[2]) < 1e-9
        assert r.m == statistics.median(pools[r.i])
        assert abs(r.s - statistics.stdev(pools[r.i])) < 1e-9


def test_rank_literals(spark):
    rank = lambda v: percentiles.percentile_rank(F.col(A), F.lit(float(v)))
    assert round(one(spark, range(1, 13), rank(11.5))[0], 1) == 95.5
    assert one(spark, [1, 5, 5, 5, 9], rank(5), rank(0), rank(10), rank(1), rank(9)) == (50.0, 0.0, 100.0, 0.0, 100.0)
    assert one(spark, [3], rank(3), rank(2), rank(4)) == (50.0, 0.0, 100.0)


def test_rank_inverts_the_percentile(spark):
    pool = [2, 3, 5, 8, 13, 21]
    shares = [0.1, 0.37, 0.5, 0.8]
    ranks = one(spark, pool, *[percentiles.percentile_rank(F.col(A), percentiles.linear_percentile(F.col(A), p)) for p in shares])
    assert all(abs(r - 100 * p) < 1e-9 for r, p in zip(ranks, shares))


def test_equality_falls_down(spark):
    f = F.lit
    row = spark.range(1).select(
        classify.two_cuts(f(2.5), f(2.0), f(2.5)).alias("a"),
        classify.two_cuts(f(2.0), f(2.0), f(2.5)).alias("b"),
        classify.four_zones(f(1.0), f(1.0), f(2.0), f(3.0)).alias("c"),
        classify.two_cuts(f(1.0), f(None).cast("double"), f(None).cast("double")).alias("d"),
        classify.first_break(f(0.5), classify.ANOMALY_BREAKS).alias("e"),
    ).first()
    assert tuple(row) == ("medio", "bajo", "exito", None, 2)


def test_suitability_bounds(spark):
    df = spark.createDataFrame([(t / 10,) for t in range(100, 450)], "t double")
    stats = df.select(suitability.thermal(F.col("t")).alias("v"), "t").agg(F.max("v"), F.min("v"), F.max_by("t", "v")).first()
    assert 0.999 < stats[0] <= 1.0 and stats[1] == 0.0 and 30 < stats[2] < 36
    assert df.filter((F.col("t") <= 16) | (F.col("t") >= 38)).filter(suitability.thermal(F.col("t")) != 0).count() == 0
    mid = spark.range(1).select(suitability.rain(F.lit(30.0)), suitability.humidity(F.lit(25.0)), suitability.humidity(F.lit(80.0))).first()
    assert tuple(mid) == (0.5, 0.5, 1.0)


def test_number_tokens(spark):
    tokens = {"33,360": 33360.0, "1.574.872": 1574872.0, "1363,652": 1363652.0, "3.4": 3.4, "0,0": 0.0, "19460": 19460.0, "n/a": None}
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", number(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == tokens


def test_names_and_files(spark):
    df = spark.createDataFrame(
        [("Departamento de  Peñón  Alto", "Boletin_SE05-06_v3.pdf"), (" LA UNIÓN", "vacaciones.pdf"), ("x", "SE072020.pdf")], "n string, f string"
    )
    rows = df.select(place_key(F.col("n")), file_week(F.col("f")), file_version(F.col("f"))).collect()
    assert [tuple(r) for r in rows] == [("penon alto", "5-6", 3), ("la union", None, 1), ("x", "07", 1)]

import re

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem".split()
DATA = "/root/testdata/sf0.001"

#: Queries with an oracle. The training-data operators have their own tests; the smallest tables hold no row that a single
#: model could be trained on.
WITHOUT_ROWS = {"M20_importance_facts", "M21_comparison_facts", "M22_score_facts", "Q2_risk_facts"}
CHECKED = [name for name in entry_module.oracle_sql() if not re.match(r"op\d|pipeline", name) and name not in WITHOUT_ROWS]
GROUPS = sorted({name[0] for name in CHECKED})


def test_registry_is_consistent():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    numbered = {q for q in queries if re.match(r"op\d|pipeline", q)}
    without = set(queries) - set(oracles) - numbered
    assert without == {"M8_forest_fold_predictions", "M20_feature_importance", "M21_algorithm_comparison", "M22_score_stored_model", "Q2_risk_of_latest_week"}


def test_flagship_query(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "percentil" in df.columns
    assert df.filter("percentil IS NULL AND nota IS NULL").count() == 0


def shown(value):
    """Text of a value; the last digits of floating-point sums may depend on the order of the rows."""
    return f"{value:.10g}" if isinstance(value, float) else str(value)


def differs(spark, con, name):
    frame = entry_module.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    rel = con.sql(entry_module.oracle_sql()[name])
    if sorted(rel.columns) != columns:
        return f"{name}: columns {columns}, {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in columns]
    expected = sorted(tuple(shown(r[i]) for i in order) for r in rel.fetchall())
    got = sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect())
    return None if got == expected else f"{name}: {len(got)} rows, {len(expected)} expected"


@pytest.mark.parametrize("letter", GROUPS)
def test_oracles(spark, letter):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert not [text for n in CHECKED if n[0] == letter and (text := differs(spark, con, n))]

import pytest

PROSE = [
    "The quick brown fox jumps over the lazy dog. It rains in the valley, and nobody minds.\nA second line follows here.",
    "Rivers carry stones to the sea. Stones become sand, and sand becomes glass after a long time.",
    "Nothing much happened on that day.",
]


@pytest.fixture
def frame(spark):
    """A documents table of ``(doc_id, text)`` pairs with extra columns, one of a name that operators use themselves."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return df.selectExpr("*", "'x' AS lang", "1 AS n", "'old' AS ids", "'old' AS fp", "7 AS score") if extra else df

    return make

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from logspark.llm.ship import ship

    ship(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, source]), with columns that clash with names the operators use inside."""

    def make(rows, clashes=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if clashes:
            df = df.selectExpr("*", "'x' AS digest", "1 AS row", "2 AS key", "3 AS size", "'y' AS words", "4 AS spans",
                               "5 AS n", "'z' AS label", "6 AS score", "7 AS start", "8 AS class", "9 AS _row")
        return df

    return make


ODD = [(1, None), (2, ""), (3, "   \t\n"), (4, "word"), (5, "word"), (6, "Word"), (None, "word"), (7, "é" * 3000),
       (8, "long " * 30_000), (8, "long " * 30_000), (9, "a\x00b \x1f c"), (10, "\U0001f600 x")]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])

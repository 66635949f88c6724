import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text) pairs, with columns whose names clash with those inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr(
            "*", "1 AS id", "'x' AS print", "2 AS row", "3 AS key", "4 AS lines", "5 AS kind", "6 AS n_removed"
        )

    return make

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # Columns whose names clash with those the operators work with or return.
        T.StructField("kept", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("_row", T.StringType()),
        T.StructField("_key", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs, with clashing extra columns."""

    def make(rows):
        return spark.createDataFrame([(k, t, "k", "s", "r", "y") for k, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null keys, null and empty texts, ties, repeated rows and a very long text."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    return [
        (1, "Alpha beta gamma delta epsilon zeta eta theta"),
        (2, "alpha  beta\tgamma delta epsilon zeta eta theta"),
        (3, "Alpha beta gamma\ndelta epsilon zeta eta theta"),
        (3, "Alpha beta gamma\ndelta epsilon zeta eta theta"),
        (None, "Alpha beta gamma\ndelta epsilon zeta eta theta"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (None, None),
        (7, long),
        (8, long),
        (9, long + " end"),
        (10, "ünï cödé   text\x85 with odd spaces\x0b"),
    ]

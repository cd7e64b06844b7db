import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)

# Nulls in every column, empty and blank texts, a long text, repeated rows, signs of other scripts.
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n\r\x0b\x0c ", "en", "s", 7), (None, "a row without an id", "en", "s", 19),
    (4, "word " * 30_000, "en", "s", 150_000), (5, "same row", "en", "s", 8), (5, "same row", "en", "s", 8),
    (6, "<|endoftext|> É́ İΣς 'S don't\x1cx y \U0001F600", "fr", None, 30), (7, "12345", None, "s", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

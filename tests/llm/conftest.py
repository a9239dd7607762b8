import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Null in every column, empty and very long texts, repeated rows, and columns whose names clash with results."""
    long = "password=abcdefghijkl " + "wort " * 40_000 + "x" * 50_000 + " +1 (212) 555-0100 a@b.co"
    rows = [(1, "one two three four", "en", "a", 1), (1, "one two three four", "en", "a", 1), (2, None, None, None, None), (3, "", "", "", 0), (None, "one two three four", "en", "a", 4),
            (None, None, None, None, None), (4, " \t\n", "en", None, 3), (5, long, "de", "b", len(long)), (6, "AKIA" + "Q" * 16 + " é " + "0123456789abcdef", "fr", "b", 9)]
    extra = "score double, spans string, component_id long, kind string, row long, word string, part int, block int, fp long, base double, key string, lines string, digest string"
    return spark.createDataFrame([Row(*r, 0.5, "x", 7, "k", 3, "w", 1, 1, 5, 0.1, "k", "l", "d") for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)

import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, an extra column."""
    long = "lorem ipsum dolor sit amet " * 8000
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 1, "x"),
        (2, "ALPHA beta gamma delta epsilon zeta.", "en", "a", 1, "x"),
        (2, "ALPHA beta gamma delta epsilon zeta.", "en", "a", 1, "x"),
        (3, None, None, None, None, None),
        (4, "", "fr", "b", 0, None),
        (None, "no id here", "en", None, 3, "y"),
        (5, long, "en", "a", 9, "z"),
        (6, long + "x", "en", "c", 9, "z"),
        (7, "ÄÖ one two  three\n\nfour\t", "de", "c", 2, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

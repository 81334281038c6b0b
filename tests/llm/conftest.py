import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal texts under several ids, and extra columns with clashing names."""
    long = "word number one and then some more of the words " * 3000
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, "Hello,  World", "c", 3), (4, "Hello,  World", "c", 4), (4, "Hello,  World", "c", 4), (5, long, "d", 5), (None, "no id\nat all", None, None), (7, "é é ΟΔΟΣ \U0001f600\r\n\tx", "e", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, tokens string, h1 int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

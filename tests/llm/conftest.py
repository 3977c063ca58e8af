import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "The same text, twice.", "en", "a"),
    (2, "The same  text,\ntwice.", "en", "a"),
    (2, "The same  text,\ntwice.", "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (5, " \t\n", None, "b"),
    (None, "A number is missing here.", "en", None),
    (6, "12 345 ... !!", "fr", "c"),
    (7, "wort " * 30_000, "de", "c"),
    (8, "x" * 200_000, None, "c"),
    (9, "Ünïcödé 中文 😀 l'été", "fr", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, ties, repeated rows, empty and long texts and columns of the names that operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    inside = ["vertex", "key", "place", "digest", "unit", "size", "band", "part", "piece", "length", "rank", "gram", "label", "n", "_id", "_stay", "_copy", "_sum", "task", "runs"]
    return df.select("*", *[F.lit("x").alias(c) for c in inside])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")

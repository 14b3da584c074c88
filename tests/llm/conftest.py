import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in any column, empty and blank texts, one very long word, repeated rows, odd characters.
ROWS = [
    (0, "The quick brown fox, jumps over the lazy dog.\nAgain!", "en", "a", 50),
    (1, None, "en", "a", None),
    (2, "", None, "b", 0),
    (3, " \t\n\x0b ", "fr", None, 5),
    (4, "x" * 5000 + " " + "aB9" * 3000, "en", "b", 14001),
    (5, "Élan naïve — 東京 😀 é  nb\x1csep\x85 ﬁ İ don't I'll 12345 ...!!", "fr", "c", 40),
    (6, "<|endoftext|> special <|startoftext|> inside<|endoftext|>text", "en", "c", 60),
    (7, "same row", "en", "a", 8),
    (7, "same row", "en", "a", 8),
    (None, "no id here", "en", "c", 10),
    (8, "word " * 3000, "en", "a", 15000),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, DOCUMENTS).withColumn("size", F.lit(1)).withColumn("bucket", F.lit("x")).withColumn("start", F.lit(2))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _size int, bucket string, spans string, component string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, ties, repeated rows, nulls in every column, columns with clashing names."""
    rows = [(0, "Mail a.b@example.com or +1 (212) 555-0199, card 4111 1111 1111 1111, ip 10.0.0.1.", "en", "s1", 70, 1, "b", "s", "c"), (1, None, None, None, None, None, None, None, None), (2, "", "en", "s1", 0, 1, "b", "s", "c"), (3, " \n\t ", "en", None, 4, 1, "b", "s", "c")]
    rows += [(4, "the quick brown fox jumps over the lazy dog " * 5000, "en", "s2", 220000, 1, "b", "s", "c"), (5, "x" * 100_000, "en", "s2", 100000, 1, "b", "s", "c"), (6, "7" * 60_000 + ".1.1.1 a@" + "b." * 9000 + "c", "en", "s2", 1, 1, "b", "s", "c")]
    rows += [(7, "Ünïcode 😀 words and 12 345 things\nand lines\nand lines\n\n#*| !!", "de", "s3", 50, 1, "b", "s", "c")] * 2 + [(8, "one two three", "en", "s3", 13, 1, "b", "s", "c"), (9, "one two three", "en", "s3", 13, 1, "b", "s", "c"), (10, "12 34 ##", "en", "s3", 8, 1, "b", "s", "c"), (None, "no id but some words here", "en", "s1", 25, 1, "b", "s", "c")]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

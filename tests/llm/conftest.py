import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, "", "en", "a", 0),
        (3, None, "de", None, None),
        (None, "ein kurzer Text ohne Nummer", "de", "b", 5),
        (None, None, None, None, None),
        (4, " \t\n ", None, "b", 3),
        (5, "wort " * 60000, "de", "b", 300000),
        (6, "x" * 200000, "en", "a", 200000),
        (7, "le chat noir été \U0001f600 12 %%%", "fr", "a", 9),
        (8, "THE Quick brown fox jumps over the lazy dog again and again", "en", "c", 10),
        (9, "the quick brown fox jumps over the lazy dog again and again", "en", "c", 10),
    ]
    df = spark.createDataFrame([r + (0.5, "t", "r") for r in rows], SCHEMA + ", score double, topic string, row string")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (5, 0, 1), (7, 1, 0), (7, 0, 1), (8, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"

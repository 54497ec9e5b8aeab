import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank and sing"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
    return [
        (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, None, "en", "a", None), (4, "", "de", None, 0), (5, " \n\t ", None, "b", 3),
        (6, long, "en", "b", 1), (7, long + " end", "en", "b", 1), (None, "no id here at all", "en", "a", 1), (8, "ÄÖÜ ß — 你好 \U0001f600", None, None, 1), (9, BASE.upper(), "en", "a", 1),
        (10, "### $$$ *** ###", "en", "a", 1), (11, "a\nb\na\n\na", "en", "a", 1), (12, "<|endoftext|> x", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder

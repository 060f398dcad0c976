import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [(1, "the cat sat on the mat. it was red.", "en", "a", 35, 7, "x", 1.0, "k"), (2, "the cat sat on the mat. it was red.", "en", "b", 35, None, None, None, None),
            (2, "the cat sat on the mat. it was red.", "en", "b", 35, None, None, None, None), (3, None, None, None, None, 1, "y", 2.0, "k"), (4, "", "de", None, 0, 2, "z", 3.0, "k"),
            (5, " \t\n ", "fr", "a", 4, 3, "x", 4.0, "k"), (None, "a text without an id, but with words.", None, "c", None, 4, "x", 5.0, "k"), (6, LONG, "en", "a", len(LONG), 5, "x", 6.0, "k"),
            (7, "one", "en", "c", 3, 6, "x", 7.0, "k"), (8, "One", "en", "c", 3, 6, "x", 7.0, "k"), (9, "été à Zürich – ñandú 😀 done.", "fr", "c", 29, 6, "x", 7.0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, _n string, shard double, _found0 string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture()
def dice():
    return random.Random(5)

"""Small documents that hold nulls, empty and long texts, ties, repeated rows and clashing column names."""

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    long_text = "the long river runs over the old stones and then " * 4000
    rows = [(1, "the cat sat on the mat and looked at the door for a while", "en", "x"), (1, "the cat sat on the mat and looked at the door for a while", "en", "x"), (2, None, None, None), (3, "", "en", "x"), (4, "1234 !!", "en", "y"), (None, "a row without id", "en", "y"), (5, long_text, "en", "x"), (6, "日本語 🙂 text ünï", None, "z")]
    return spark.createDataFrame([(*r, 1, "h", 2) for r in rows], "doc_id long, text string, lang string, source string, fp int, digest string, score int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

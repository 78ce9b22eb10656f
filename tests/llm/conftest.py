import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated texts, null ids and sources, columns whose names clash."""
    rows = [
        (1, None, None, "s", 1, 1, 1.0),
        (2, "", "en", None, 1, 1, 1.0),
        (3, " \t\n\n ", "en", "s", 1, 1, 1.0),
        (4, "a b", "en", "s", None, 1, 1.0),
        (None, "a b", None, "s", 1, None, 1.0),
        (5, "one two three four five six\nline", "en", "t", 1, 1, None),
        (5, "one two three four five six\nline", "en", "t", 1, 1, None),
        (5, "another text under the same id", "en", "t", 1, 1, None),
        (6, "ÉÀ ñ \x00 x y " + "long " * 30000, "fr", "t", 1, 1, 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, key int, v double")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)

import pytest

# Nulls in every column, empty and very long texts, ties, repeated rows, and a clashing extra column.
ROWS = [
    (1, "the red fox runs over the old hill today", "en", "b", "x"),
    (2, "the red fox runs over the old hill today", "en", "b", "x"),
    (3, None, "en", "a", "x"),
    (4, "", None, None, None),
    (5, "word " * 9000 + "end", "en", "a", "x"),
    (6, "Le chat dort sur la table, la nuit.", "fr", "a", "x"),
    (7, "Le chat dort sur la table, la nuit.", "fr", None, "x"),
    (8, "1234 !!", "fr", "c", "x"),
    (9, "a" * 300_000, None, "c", "x"),
    (None, "no id here at all my friend", "en", "b", "x"),
    (10, "tie", "en", "b", "x"),
    (10, "tie", "en", "b", "x"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

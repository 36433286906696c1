"""Fixtures that the tests of the text operators import."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASHING = ["row", "stats", "kept", "mark", "content", "score", "label", "group", "found", "value", "key", "ids"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, and extra
    columns with names of the operators' own."""
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (4, " \t\n\r ", "en", None, 4),
        (None, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
        (5, long, None, None, len(long)),
        (6, "x", "de", "b", 1),
        (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'{name}!' AS `{name}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

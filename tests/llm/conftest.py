import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, copies string, n_removed string, keep int, host string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls anywhere, empty and very long texts, ties, repeated rows, columns whose names clash with results."""
    long = "word " * 40_000 + "x" * 200_000
    copy = "one two three four five six seven eight nine ten\nline two of it here\nline three of it here\nline four of it"
    texts = [(1, copy, "b"), (2, copy, "a"), (2, copy, "a"), (3, "", "a"), (4, None, None), (None, copy, "b"), (None, None, None), (5, long, "é"), (6, " \n\t\n ", "a"), (7, copy + " more", "c"), (8, "a\na\na\na\na", "a"), (9, "short", "z")]
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", "y", 0, "h") for i, t, s in texts], DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, fp string, batch string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    prose = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, None, "en", "a", None, 7, 1, "x", None), (2, "", "en", "a", 0, 7, 1, "x", None), (3, prose, "en", "a", 1, None, 1, "x", None),
        (4, prose.upper(), None, "b", 1, 7, None, "x", None), (5, prose + " ÉCOLE", "fr", None, 1, 7, 1, None, "y"), (6, prose + " école", "fr", "b", 1, 7, 1, "x", "y"),
        (7, " \t\n", "de", "c", 3, 7, 1, "x", "y"), (8, "word " * 30_000, "de", "c", 3, 7, 1, "x", "y"), (9, "a\x0bb\x0cc d", "es", "c", 3, 7, 1, "x", "y"),
        (10, prose, "en", "a", 1, None, 1, "x", None), (10, prose, "en", "a", 1, None, 1, "x", None), (None, "lonely text without id", "en", "d", 1, 1, 1, "x", "y"),
        (12, "日本語の文章です。\n二行目", "ja", "d", 1, 1, 1, "x", "y"), (13, "123 456\n\n!!! ???", "en", "d", 1, 1, 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

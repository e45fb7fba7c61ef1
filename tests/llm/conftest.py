import pytest

#: Columns whose names clash with those that operators make for themselves.
EXTRA = "uid long, id long, score double, kept boolean, size int, fp long, label string, c long, token string, digit string, grp long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), 7, 7, 0.5, True, 1, 9, "x", 3, "t", "d", 0)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, repeated rows, ties, a null id."""
    long = "the moron went home " * 20000
    prose = "An ordinary sentence stands here for all to read, and nothing in it is odd."
    return [
        row(1, None),
        row(2, ""),
        row(3, " \n\t "),
        row(4, long),
        row(5, long + "x"),
        row(6, prose),
        row(6, prose),
        row(7, prose, None, None),
        row(8, prose.replace(" ", "  ")),
        row(None, "A row without an id, which says something else than the others do."),
        row(9, "Über die Straße ging ein 日本 Kind 😀, und alles war gut."),
        row(10, "one"),
        row(11, "mail me at someone@example.com or call +1 (555) 123-4567 from 10.0.0.1"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

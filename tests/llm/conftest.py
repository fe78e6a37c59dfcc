import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


#: Nulls in every column, empty and blank texts, one long text, ties, repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None),
    (6, "a b c d e f g h"), (7, "A b c d e f g h"), (8, "x y " * 30_000), (9, "ÄÖ ü ß   İ ｆ ǆ ²"), (10, "<|endoftext|> it's we've don't 12"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])

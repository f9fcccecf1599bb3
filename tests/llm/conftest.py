import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table like documents, with columns whose names operators use themselves."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
        return df.selectExpr("*", "1 as node", "'x' as kept", "2 as size", "3 as copies") if extra else df

    return make


#: Rows that every operator takes: null in any column, empty and odd texts, repeated rows.
ODD = [(None, "no id at all here now", None), (1, None, "s"), (2, "", "s"), (3, "one", None), (4, "  \n\t ", "s"), (5, "é ß 日本 😀", ""), (5, "é ß 日本 😀", ""), (6, "w " * 30000, "s"), (7, "x" * 100000, "s")]


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

import pytest

from flowloom.session import ship_package


@pytest.fixture(scope="session", autouse=True)
def _shipped(spark):
    ship_package(spark)


@pytest.fixture
def docs_of(spark):
    """Documents of (id, text) pairs with further columns, some of them named like the operators' own."""
    def make(rows):
        rows = [(i, t, None, "x", 0.5, [1]) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, score double, ids array<int>")
    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (7, "word " * 30_000), (8, "é漢😀 <|endoftext|> 's"), (9, "\x00\x1c\x85\xa0")]


@pytest.fixture
def odd():
    return list(ODD)

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empties, repeats, a long text, and extra columns whose names clash with what the operators add."""
    long = "word" * 3 + " " + "lorem ipsum dolor sit amet, " * 4000
    rows = [(1, None, "x", 1), (2, "", "x", 2), (None, "some text without an id", "x", 3), (3, long, "x", 4), (4, "a b c", "x", 5), (4, "a b c", "x", 5), (5, "a b c", None, None), (6, " \n\t ", "x", 7), (7, "z" * 3000, "x", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, kept long")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")

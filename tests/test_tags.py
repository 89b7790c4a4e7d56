import pytest
from pyspark.sql import functions as F

from vicinage.functions import tags

NUMERIC = {"12": 12, "12.5": 12.5, "12 m": 12, "12m": 12, "12 meters": 12, "12 metres": 12, " 12 ": 12, "40'": 12.192, "40 ft": 12.192, "40ft": 12.192, "1e2": 100, ".5": 0.5, "1000": 1000, "40' m": 12.192}
NULLS = [None, "", "nan", "tall", "~12", "NaN", "-5", "0", "5000", "12meters", "12d", "+nan", "inf", "1 2"]


@pytest.fixture(scope="module")
def heights(spark):
    df = spark.createDataFrame([(x,) for x in [*NUMERIC, *NULLS]], "tag string")
    return {r[0]: r[1] for r in df.select("tag", tags.height_m(F.col("tag"))).collect()}


def test_heights(heights):
    for tag, value in NUMERIC.items():
        assert heights[tag] == pytest.approx(value, abs=0.01), tag
    assert all(heights[x] is None for x in NULLS)


def test_levels(spark):
    want = {"4": 4, "4.5": 4, "5.5": 6, "1": 1, "-1": -1, None: None, "": None, "nan": None, "tall": None, "inf": None, "1e30": None}
    df = spark.createDataFrame([(x,) for x in want], "tag string")
    assert {r[0]: r[1] for r in df.select("tag", tags.levels(F.col("tag"))).collect()} == want


def test_provenance(spark):
    df = spark.createDataFrame([("12", "4"), (None, "4"), ("tall", "0"), (None, None)], "h string, l string")
    h, s = tags.height_with_source(F.col("h"), F.col("l"))
    assert [tuple(r) for r in df.select(h, s).collect()] == [(12.0, "tag"), (14.0, "levels"), (None, "none"), (None, "none")]

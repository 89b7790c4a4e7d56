import pytest
from pyspark.sql import functions as F

from vicinage.functions import polygon

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
L_SHAPE = [(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10), (0, 0)]
LINE = [(0, 0), (4, 0), (8, 0), (0, 0)]


def measure(spark, ring):
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in ring],)], "r array<struct<e: double, n: double>>")
    return df.select(polygon.area(F.col("r")).alias("a"), polygon.centroid(F.col("r")).alias("c")).first()


@pytest.mark.parametrize("ring,area,centre", [(SQUARE, 100, (5, 5)), (SQUARE[::-1], 100, (5, 5)), (L_SHAPE, 75, (4.1667, 4.1667)), (LINE, 0, (3, 0))])
def test_area_and_centroid(spark, ring, area, centre):
    got = measure(spark, ring)
    assert got.a == pytest.approx(area) and got.c.e == pytest.approx(centre[0], abs=1e-3) and got.c.n == pytest.approx(centre[1], abs=1e-3)


def test_empty_ring(spark):
    got = measure(spark, [])
    assert got.a is None and got.c is None


def test_largest_part_and_ties(spark):
    ring = lambda x, s: [(x, 0.0), (x + s, 0.0), (x + s, s), (x, s), (x, 0.0)]
    df = spark.createDataFrame([([ring(0.0, 1.0), ring(5.0, 2.0)],), ([ring(0.0, 2.0), ring(5.0, 2.0)],)], "p array<array<struct<lon: double, lat: double>>>")
    assert [r[0][0].lon for r in df.select(polygon.largest_part(F.col("p"))).collect()] == [5.0, 0.0]

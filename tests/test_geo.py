import math

import pytest
from pyspark.sql import functions as F

from vicinage.functions import geo

LAT0, LON0 = 47.6062, -122.3321


def enu(spark, points, origin=(LAT0, LON0, 0.0)):
    df = spark.createDataFrame([(float(a), float(b), float(c), *map(float, origin)) for a, b, c in points], "lat double, lon double, ele double, lat0 double, lon0 double, ele0 double")
    e, n, u = geo.to_enu(*(F.col(c) for c in df.columns))
    placed = df.select("*", e.alias("e"), n.alias("n"), u.alias("u"))
    lat, lon, ele = geo.from_enu(*(F.col(c) for c in ("e", "n", "u", "lat0", "lon0", "ele0")))
    return placed.select("*", lat.alias("lat1"), lon.alias("lon1"), ele.alias("ele1")).collect()


def test_origin_axes_and_round_trip(spark):
    points = [(LAT0, LON0, 0), (LAT0 + 0.001, LON0, 0), (LAT0, LON0 + 0.001, 0), (LAT0, LON0, 100), (LAT0 + 0.001, LON0 + 0.001, 10), (LAT0 - 0.002, LON0 + 0.003, -5), (LAT0 + 0.0005, LON0 - 0.0005, 100)]
    rows = enu(spark, points)
    assert all(abs(rows[0][c]) < 1e-6 for c in "enu")
    assert rows[1].n > 100 and abs(rows[1].e) < 0.1 and rows[2].e > 70 and abs(rows[2].n) < 0.1
    assert abs(rows[3].u - 100) < 0.1
    for r in rows:
        assert abs(r.lat1 - r.lat) < 1e-8 and abs(r.lon1 - r.lon) < 1e-8 and abs(r.ele1 - r.ele) < 0.01


def test_enu_agrees_with_haversine_nearby(spark):
    r = enu(spark, [(LAT0 + 0.00045, LON0 + 0.00067, 0)])[0]
    d = spark.range(1).select(geo.haversine_m(F.lit(LAT0), F.lit(LON0), F.lit(LAT0 + 0.00045), F.lit(LON0 + 0.00067))).first()[0]
    assert abs(math.hypot(r.e, r.n) - d) < 0.2


def test_haversine(spark):
    same, far = spark.range(1).select(geo.haversine_m(F.lit(LAT0), F.lit(LON0), F.lit(LAT0), F.lit(LON0)), geo.haversine_m(F.lit(LAT0), F.lit(LON0), F.lit(45.5152), F.lit(-122.6784))).first()
    assert same == 0 and 230_000 < far < 240_000


def test_box_and_split(spark):
    df = spark.createDataFrame([(47.6059, -122.3392, 150.0), (47.6059, -122.3392, 300.0)], "lat double, lon double, r double").select("*", geo.radius_box(F.col("lat"), F.col("lon"), F.col("r")).alias("bbox"))
    a, b = (r.bbox for r in df.orderBy("r").collect())
    assert a.w < -122.3392 < a.e and a.s < 47.6059 < a.n
    assert abs((a.e + a.w) / 2 + 122.3392) < 1e-10 and abs((b.e - b.w) - 2 * (a.e - a.w)) < 1e-10
    cells = geo.split_box(df.where("r = 150"), n=2).orderBy("i", "j").collect()
    assert [(c.i, c.j) for c in cells] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert cells[0].cell.s == pytest.approx(a.s) and cells[3].cell.n == pytest.approx(a.n) and cells[0].cell.e == pytest.approx(cells[1].cell.w)


def test_bearings(spark):
    df = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (90.0, 270.0), (None, 5.0), (-10.0, 370.0)], "a double, b double")
    assert [r[0] for r in df.select(geo.bearing_gap(F.col("a"), F.col("b"))).collect()] == [20, 20, 180, 0, 20]
    dx, dy = spark.range(1).select(*geo.heading_vector(F.lit(90.0))).first()
    assert dx == pytest.approx(8) and dy == pytest.approx(0, abs=1e-9)

"""Geodesy as column expressions: WGS84 to a local east-north-up frame and back, distances, boxes, bearings.

Everything is plain arithmetic on columns, so it stays inside whole-stage code generation. Frames are columns too:
a batch of queries with an origin each is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEMI_MAJOR = 6378137.0
SEMI_MINOR = 6356752.314245179
EARTH_RADIUS = 6371008.8
METRES_PER_DEGREE = 111_000.0
_A2, _B2 = SEMI_MAJOR**2, SEMI_MINOR**2


def _ecef(lat: Column, lon: Column, ele: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    normal = _A2 / F.sqrt(_A2 * F.cos(phi) * F.cos(phi) + _B2 * F.sin(phi) * F.sin(phi))
    flat = (normal + ele) * F.cos(phi)
    return flat * F.cos(lam), flat * F.sin(lam), (normal * (_B2 / _A2) + ele) * F.sin(phi)


def to_enu(lat: Column, lon: Column, ele: Column, lat0: Column, lon0: Column, ele0: Column) -> tuple[Column, Column, Column]:
    """East, north, up in metres from the origin (lat0, lon0, ele0)."""
    x, y, z = _ecef(lat, lon, ele)
    x0, y0, z0 = _ecef(lat0, lon0, ele0)
    dx, dy, dz = x - x0, y - y0, z - z0
    phi, lam = F.radians(lat0), F.radians(lon0)
    along = F.cos(lam) * dx + F.sin(lam) * dy
    return -F.sin(lam) * dx + F.cos(lam) * dy, -F.sin(phi) * along + F.cos(phi) * dz, F.cos(phi) * along + F.sin(phi) * dz


def origin_columns(lat0: Column, lon0: Column, ele0: Column) -> Column:
    """What every point of a frame needs of its origin, computed once a frame: a struct to carry on the query side."""
    x, y, z = _ecef(lat0, lon0, ele0)
    phi, lam = F.radians(lat0), F.radians(lon0)
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.sin(phi).alias("sp"), F.cos(phi).alias("cp"), F.sin(lam).alias("sl"), F.cos(lam).alias("cl"))


def ring_to_enu(ring: Column, origin: Column) -> Column:
    """ARRAY<STRUCT<lon, lat>> at height 0 to ARRAY<STRUCT<e, n>> in the frame of ``origin`` (see origin_columns).

    Higher-order functions aren't compiled and share no subexpressions, so each step is a pass that computes its
    values once per vertex: sines and cosines, geocentric coordinates, then the rotation.
    """
    trig = F.transform(ring, lambda p: F.struct(F.sin(F.radians(p["lat"])).alias("s"), F.cos(F.radians(p["lat"])).alias("c"), F.radians(p["lon"]).alias("l")))
    normal = F.transform(trig, lambda t: F.struct((_A2 / F.sqrt(_A2 * t["c"] * t["c"] + _B2 * t["s"] * t["s"])).alias("r"), t["s"].alias("s"), t["c"].alias("c"), t["l"].alias("l")))
    offset = F.transform(normal, lambda t: F.struct((t["r"] * t["c"] * F.cos(t["l"]) - origin["x"]).alias("x"), (t["r"] * t["c"] * F.sin(t["l"]) - origin["y"]).alias("y"), (t["r"] * (_B2 / _A2) * t["s"] - origin["z"]).alias("z")))
    return F.transform(offset, lambda d: F.struct((origin["cl"] * d["y"] - origin["sl"] * d["x"]).alias("e"), (origin["cp"] * d["z"] - origin["sp"] * (origin["cl"] * d["x"] + origin["sl"] * d["y"])).alias("n")))


def from_enu(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, ele0: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude, elevation of a point in the frame; one step of Bowring's formula."""
    x0, y0, z0 = _ecef(lat0, lon0, ele0)
    phi, lam = F.radians(lat0), F.radians(lon0)
    out = F.cos(phi) * u - F.sin(phi) * n
    x, y, z = x0 - F.sin(lam) * e + F.cos(lam) * out, y0 + F.cos(lam) * e + F.sin(lam) * out, z0 + F.cos(phi) * n + F.sin(phi) * u
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * SEMI_MAJOR, p * SEMI_MINOR)
    s, c = F.sin(theta), F.cos(theta)
    lat = F.atan2(z + (_A2 / _B2 - 1) * SEMI_MINOR * s * s * s, p - (1 - _B2 / _A2) * SEMI_MAJOR * c * c * c)
    normal = _A2 / F.sqrt(_A2 * F.cos(lat) * F.cos(lat) + _B2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - normal


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere; a coarse filter before projecting."""
    s, t = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def radius_box(lat: Column, lon: Column, radius_m: Column) -> Column:
    """struct<w, s, e, n> around a point: a square of side 2 r, not clipped to the circle."""
    high = radius_m / METRES_PER_DEGREE
    wide = radius_m / (METRES_PER_DEGREE * F.cos(F.radians(lat)))
    return F.struct((lon - wide).alias("w"), (lat - high).alias("s"), (lon + wide).alias("e"), (lat + high).alias("n"))


def split_box(df: DataFrame, box: str = "bbox", n: int = 3) -> DataFrame:
    """A row per sub-box in row-major order, south to north and then west to east: adds i, j, cell."""
    b = F.col(box)
    high, wide = (b["n"] - b["s"]) / n, (b["e"] - b["w"]) / n
    cells = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i, j = F.col("i"), F.col("j")
    return cells.withColumn("cell", F.struct((b["w"] + j * wide).alias("w"), (b["s"] + i * high).alias("s"), (b["w"] + (j + 1) * wide).alias("e"), (b["s"] + (i + 1) * high).alias("n")))


def heading_vector(compass: Column, length: float = 8.0) -> tuple[Column, Column]:
    """Arrow of a compass bearing (clockwise from north) in the east-north plane."""
    theta = F.radians(90 - compass)
    return length * F.cos(theta), length * F.sin(theta)


def bearing_gap(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings in degrees, 0 if either is missing; any real bearing is taken modulo 360."""
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(b, F.lit(360.0)))
    return F.coalesce(F.least(d, 360 - d), F.lit(0.0))

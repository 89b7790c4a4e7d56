"""Polygon measures over ARRAY<STRUCT<e, n>> rings, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once; without it an inlined array is rebuilt at every access."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(ring: Column, x: str, y: str, start: Column, step) -> Column:
    """Fold over the ring's edges, cyclic: the edge after the last vertex leads back to the first."""
    size = F.size(ring)
    edges = F.sequence(F.lit(0), size - 1)

    def one(acc, i):
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, size))
        return step(acc, a[x], a[y], b[x], b[y])

    return F.aggregate(edges, start, one)


def signed_area(ring: Column, x: str = "e", y: str = "n") -> Column:
    return let(ring, lambda r: F.when(F.size(r) > 0, _fold(r, x, y, F.lit(0.0), lambda acc, ax, ay, bx, by: acc + (ax * by - ay * bx)) * 0.5))


def area(ring: Column, x: str = "e", y: str = "n") -> Column:
    """Shoelace area of the exterior ring; holes don't count. NULL for an empty ring."""
    return F.abs(signed_area(ring, x, y))


def centroid(ring: Column, x: str = "e", y: str = "n") -> Column:
    """struct<e, n>: area-weighted, whatever the orientation; a ring without area gives the mean of its vertices."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc, ax, ay, bx, by):
        cross = ax * by - ay * bx
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y"))

    def own(r: Column, t: Column) -> Column:
        flat = F.abs(t["a"]) * 0.5 < 1e-10
        mean = lambda c: F.aggregate(r, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(r)
        part = lambda c, k: F.when(flat, mean(c)).otherwise(t[k] / F.when(flat, F.lit(1.0)).otherwise(3 * t["a"]))
        return F.struct(part(x, "x").alias("e"), part(y, "y").alias("n"))

    return let(ring, lambda r: F.when(F.size(r) > 0, let(_fold(r, x, y, start, step), lambda t: own(r, t))))


def largest_part(parts: Column, x: str = "lon", y: str = "lat") -> Column:
    """The exterior ring of greatest planar area in degrees; the first of equals."""
    sized = F.transform(parts, lambda ring, i: F.struct(area(ring, x, y).alias("area"), (-i).alias("order"), ring.alias("ring")))
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.array_max(sized)["ring"])

"""Plot-ready tables: coloured layers, counts, extent, radius circle, step counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.functions.geo import heading_vector

#: Colours by height provenance and by compass.
HEIGHT_COLOURS = {"tag": "#3b5998", "levels": "#7ba7d4", "none": "#c8c8c8"}
ORIENTED, UNORIENTED = "#2e9949", "#8ab78f"


def building_layer(buildings: DataFrame) -> DataFrame:
    colour = F.lit(None).cast("string")
    for source, value in HEIGHT_COLOURS.items():
        colour = F.when(F.col("height_source") == source, F.lit(value)).otherwise(colour)
    return buildings.select("qid", "osm_id", "footprint", colour.alias("colour"))


def image_layer(images: DataFrame) -> DataFrame:
    """Dots, and arrows where there is a compass."""
    dx, dy = heading_vector(F.col("compass_deg"))
    oriented = F.col("compass_deg").isNotNull()
    return images.select("qid", "image_id", "e", "n", dx.alias("dx"), dy.alias("dy"), F.when(oriented, F.lit(ORIENTED)).otherwise(F.lit(UNORIENTED)).alias("colour"))


def height_summary(buildings: DataFrame) -> DataFrame:
    return buildings.groupBy("qid").agg(*(F.count_if(F.col("height_source") == s).alias(f"n_{s}") for s in HEIGHT_COLOURS))


def compass_summary(images: DataFrame) -> DataFrame:
    return images.groupBy("qid").agg(F.count_if(F.col("compass_deg").isNotNull()).alias("n_oriented"), F.count_if(F.col("compass_deg").isNull()).alias("n_unoriented"))


def extent(queries: DataFrame, buildings: DataFrame, images: DataFrame, margin: float = 1.1, least: float = 100.0) -> DataFrame:
    """Half side of the square that holds both layers and the radius; 100 where there is nothing to show."""
    reach = lambda p: F.greatest(F.abs(p["e"]), F.abs(p["n"]))
    far = buildings.select("qid", F.array_max(F.transform("footprint", reach)).alias("far")).unionByName(images.select("qid", F.greatest(F.abs("e"), F.abs("n")).alias("far")))
    most = far.groupBy("qid").agg(F.max("far").alias("far"))
    return queries.join(most, "qid", "left").select("qid", F.when(F.col("far").isNull() & F.col("radius_m").isNull(), F.lit(least)).otherwise(margin * F.greatest("far", "radius_m")).alias("half_side"))


def radius_circle(queries: DataFrame, points: int = 360) -> DataFrame:
    """The circle's vertices, both ends included."""
    angle = F.col("k") / F.lit(points - 1.0) * (2 * math.pi)
    return queries.select("qid", "radius_m", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).select("qid", "k", (F.col("radius_m") * F.cos(angle)).alias("e"), (F.col("radius_m") * F.sin(angle)).alias("n"))


def step_counts(steps: dict[str, DataFrame]) -> DataFrame:
    """qid, step, n_rows of every step, as one union of partial aggregates."""
    out = None
    for name, df in steps.items():
        part = df.groupBy("qid").agg(F.count("*").alias("n_rows")).select("qid", F.lit(name).alias("step"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out

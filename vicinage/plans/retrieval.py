"""The two composite retrievals, keyed by query, as lazy plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.functions.geo import origin_columns, ring_to_enu
from vicinage.functions.polygon import area, largest_part, let
from vicinage.functions.tags import height_with_source
from vicinage.operators import images as im
from vicinage.operators.sampling import sample

POLYGONS = ("Polygon", "MultiPolygon")


def footprints(features: DataFrame, frames: DataFrame) -> DataFrame:
    """Polygonal features with their largest part's exterior ring in the query's frame: adds ``footprint``, ``area_m2``.

    Both come out of a generator, so that a filter on the area doesn't project the ring a second time.
    """
    origins = frames.select("qid", origin_columns(F.col("lat0"), F.col("lon0"), F.lit(0.0)).alias("origin"))
    kept = features.where(F.col("geom_type").isin(*POLYGONS)).join(origins, "qid")
    ring = ring_to_enu(largest_part(F.col("parts")), F.col("origin"))
    once = let(ring, lambda r: F.struct(r.alias("footprint"), area(r).alias("area_m2")))
    return kept.select(*(c for c in kept.columns if c != "origin"), F.inline(F.array(once)))


def buildings(features: DataFrame, frames: DataFrame, min_area_m2: float = 20.0) -> DataFrame:
    """qid, osm_id, footprint, height_m, height_source, building_type of footprints of at least ``min_area_m2``.

    The area test comes before the height expressions. Frames may be shared by several queries.
    """
    sized = footprints(features, frames).where(F.col("area_m2") >= min_area_m2)
    height, source = height_with_source(F.col("height_tag"), F.col("levels_tag"))
    return sized.select("qid", "osm_id", "footprint", height.alias("height_m"), source.alias("height_source"), F.coalesce("building", F.lit("yes")).alias("building_type"))


def street_images(raw: DataFrame, frames: DataFrame, thumbs: DataFrame | Callable[[DataFrame], DataFrame] | None = None, target_count: int = 100, seed: int | None = 0) -> DataFrame:
    """Deduplicated, parsed and sampled images. Thumbnails (image_id, url) are joined to the sample only; a function is
    asked for those of the sample, so that a lookup by id is made for the chosen images alone."""
    chosen = sample(im.parse(im.dedup_by_id(raw), frames), target_count, seed)
    if thumbs is not None:
        chosen = im.with_thumbs(chosen, thumbs(chosen) if callable(thumbs) else thumbs)
    return chosen

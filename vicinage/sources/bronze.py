"""Readers of raw payloads: GeoJSON feature collections and JSON lists of image items, through VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_columns(rows: DataFrame) -> DataFrame:
    """Columns of GeoJSON features (VARIANT ``f``): osm_id, geom_type, parts, height_tag, levels_tag, building.

    ``parts`` holds each part's exterior ring as ARRAY<STRUCT<lon, lat>>; holes are dropped; a point has none. The
    nesting differs by type, so each type has its own path. The id is carried as data (``osmid`` or ``id``). Other
    columns stay.
    """
    get = lambda p, kind: F.try_variant_get("f", p, kind)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    ring = lambda rings: F.transform(F.get(rings, F.lit(0)), point)
    one = F.array(ring(get("$.geometry.coordinates", "array<array<array<double>>>")))
    many = F.transform(get("$.geometry.coordinates", "array<array<array<array<double>>>>"), ring)
    kind = get("$.geometry.type", "string")
    return rows.select(
        F.coalesce(get("$.properties.osmid", "bigint"), get("$.properties.id", "bigint")).alias("osm_id"),
        kind.alias("geom_type"),
        F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).alias("parts"),
        get("$.properties.height", "string").alias("height_tag"),
        F.try_variant_get("f", "$.properties['building:levels']", "string").alias("levels_tag"),
        get("$.properties.building", "string").alias("building"),
        *(c for c in rows.columns if c != "f"),
    )


def parse_features(items: DataFrame, payload: str = "payload") -> DataFrame:
    """Features given as JSON, one a row."""
    return feature_columns(items.withColumn("f", F.try_parse_json(F.col(payload))).drop(payload))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file"))


def read_feature_items(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files as JSON, one a row: payload, file."""
    return spark.sql("SELECT to_json(f.value) AS payload, file FROM {files}, LATERAL variant_explode(try_variant_get(v, '$.features', 'variant')) AS f", files=_documents(spark, path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files, parsed, with their file."""
    return feature_columns(spark.sql("SELECT f.value AS f, file FROM {files}, LATERAL variant_explode(try_variant_get(v, '$.features', 'variant')) AS f", files=_documents(spark, path)))


def read_image_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON files that hold a list, or an object with the list under ``data``: arrival, payload, file."""
    listed = _documents(spark, path).withColumn("items", F.coalesce(F.try_variant_get("v", "$.data", "variant"), F.col("v")))
    return spark.sql("SELECT CAST(i.pos AS BIGINT) AS arrival, to_json(i.value) AS payload, file FROM {listed}, LATERAL variant_explode(items) AS i", listed=listed)

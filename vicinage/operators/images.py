"""Image records: parsing, order-safe dedup, thumbnails, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.geo import to_enu


def dedup_by_id(raw: DataFrame, id_col: str = "raw_id", order: str = "arrival") -> DataFrame:
    """The first arrival of each (query, id); empty and null ids are dropped.

    Ties in the order go to the least row. It is a partial aggregate, so copies of one id are reduced before the shuffle and a
    hot id can't fill a task.
    """
    rest = [c for c in raw.columns if c not in ("qid", id_col)]
    first = raw.where(F.col(id_col) != "").groupBy("qid", id_col).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("_r"))
    return first.select(*(F.col(c) if c in ("qid", id_col) else F.col(f"_r.{c}").alias(c) for c in raw.columns))


def parse(raw: DataFrame, frames: DataFrame) -> DataFrame:
    """Typed images in their query's frame: qid, arrival, image_id, e, n, compass_deg, captured_at, sequence_id.

    An item without id, position or time is skipped; one without compass is kept.
    """
    zero = F.lit(0.0)
    placed = raw.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("captured_ms").isNotNull() & F.col("raw_id").isNotNull()).join(frames.select("qid", "lat0", "lon0"), "qid")
    e, n, _ = to_enu(F.col("lat"), F.col("lon"), zero, F.col("lat0"), F.col("lon0"), zero)
    return placed.select("qid", "arrival", F.col("raw_id").alias("image_id"), e.alias("e"), n.alias("n"), F.col("compass").alias("compass_deg"), F.timestamp_millis("captured_ms").alias("captured_at"), "sequence_id")


def parse_json(items: DataFrame, payload: str = "payload") -> DataFrame:
    """Raw JSON items (one text a row) to the columns ``parse`` wants; a malformed field makes the row's value null.

    A compass that is there but no number marks the item as malformed, so its position is nulled and it is skipped.
    """
    v = F.try_parse_json(F.col(payload))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    bad = get("$.compass_angle", "string").isNotNull() & get("$.compass_angle", "double").isNull()
    position = lambda k: F.when(~bad, get(f"$.geometry.coordinates[{k}]", "double"))
    return items.withColumns({"raw_id": get("$.id", "string"), "lon": position(0), "lat": position(1), "compass": get("$.compass_angle", "double"), "captured_ms": get("$.captured_at", "bigint")}).drop(payload)


def with_thumbs(images: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Thumbnail URLs of the sampled images only (the join comes after sampling), '' where there is none."""
    url = F.coalesce("url", F.lit(""))
    return images.join(thumbs.select("image_id", "url"), "image_id", "left").withColumn("thumb_url", url).withColumn("thumb_path", F.when(F.col("thumb_url") != "", F.concat(F.lit("thumbnails/"), "image_id", F.lit(".jpg")))).drop("url")


def coverage(images: DataFrame, queries: DataFrame, least: int) -> DataFrame:
    """Images per query, zero included, and whether that is good coverage."""
    counts = images.groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_images"), (F.coalesce("n", F.lit(0)) >= least).alias("covered"))


def nearest(images: DataFrame, max_m: float = 100.0, limit: int = 20) -> DataFrame:
    """At most ``limit`` images within ``max_m``, nearest first, ties by id; adds dist_m and rank."""
    d = images.withColumn("dist_m", F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n"))).where(F.col("dist_m") <= max_m)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist_m", "image_id"))).where(F.col("rank") <= limit)

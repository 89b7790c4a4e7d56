"""Operators that the specification describes beyond retrieval: source priority, licences, splits, metrics, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Geometry sources from best to worst, and the licence of each data source.
PRIORITY = ("survey", "lidar", "lod2", "lod1")
LICENSES = {"osm": "ODbL", "usgs": "public domain", "mapillary": "CC-BY-SA"}


def by_priority(features: DataFrame, key: str = "feature_id", source: str = "source") -> DataFrame:
    """The best source's row of each feature, its provenance kept; reduced before the shuffle."""
    rank = F.array_position(F.array(*(F.lit(x) for x in PRIORITY)), F.col(source))
    rest = [c for c in features.columns if c != key]
    best = features.where(rank > 0).groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def with_license(layers: DataFrame, source: str = "source") -> DataFrame:
    """The licence of each row's source; the table of sources is a literal map, so there is nothing to join."""
    known = F.create_map(*(F.lit(x) for pair in LICENSES.items() for x in pair))
    return layers.withColumn("license", F.element_at(known, F.col(source)))


def usable_images(images: DataFrame) -> DataFrame:
    return images.where(~F.col("is_pano"))


def aligned(queries: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """References of at least the threshold confidence; a query without any keeps one row of nulls."""
    good = refs.where(F.col("confidence") >= threshold).select("qid", "image_id", "confidence")
    return queries.select("qid").join(good, "qid", "left")


def best_reference(refs: DataFrame) -> DataFrame:
    """The most confident image of each query, ties to the smaller id."""
    order = F.struct((-F.col("confidence")).alias("c"), F.col("image_id").alias("i"))
    return refs.groupBy("qid").agg(F.min(order).alias("m")).select("qid", (-F.col("m.c")).alias("confidence"), F.col("m.i").alias("image_id"))


def holdout(images: DataFrame, parts: int = 5) -> DataFrame:
    """Whole sequences are held out, by arithmetic on their id."""
    return images.withColumn("split", F.when(F.col("sequence_id") % parts == 0, F.lit("heldout")).otherwise(F.lit("train")))


def leaks(split: DataFrame) -> DataFrame:
    """Sequences that appear on both sides of the split; there should be none."""
    sides = split.groupBy("sequence_id").agg(F.count_if(F.col("split") == "heldout").alias("n_heldout"), F.count_if(F.col("split") == "train").alias("n_train"))
    return sides.where((F.col("n_heldout") > 0) & (F.col("n_train") > 0))


def silhouette_iou(pixels: DataFrame) -> DataFrame:
    both, either = F.sum((F.col("gt") * F.col("gen")).cast("long")), F.sum(F.greatest("gt", "gen").cast("long"))
    return pixels.groupBy("scene").agg(both.alias("n_both"), either.alias("n_either"), F.when(either > 0, both / either).alias("iou"))


def skyline_error(pixels: DataFrame, max_shift: int = 8) -> DataFrame:
    """Mean vertical gap between the two skylines at the horizontal shift where it is least (the smallest such).

    The skyline of a column is its topmost set pixel; only columns that both have are compared.
    """
    top = lambda c: pixels.where(F.col(c) == 1).groupBy("scene", "px").agg(F.min("py").alias(f"top_{c}"))
    shifted = top("gen").withColumn("shift", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift)))).withColumn("px", F.col("px") + F.col("shift"))
    gaps = top("gt").join(shifted, ["scene", "px"]).groupBy("scene", "shift").agg(F.avg(F.abs(F.col("top_gt") - F.col("top_gen"))).alias("error"))
    least = gaps.groupBy("scene").agg(F.min(F.struct("error", F.abs("shift").alias("a"), "shift")).alias("m"))
    return least.select("scene", F.col("m.shift").alias("shift"), F.col("m.error").alias("error"))


def landmark_accuracy(landmarks: DataFrame, pixels: DataFrame, reach: int = 3) -> DataFrame:
    """Share of landmarks with a generated pixel within ``reach`` in both directions.

    A range join as an equi-join: pixels and landmarks meet on grid cells of side ``reach``, a landmark in the
    3 x 3 cells around its own.
    """
    near = F.sequence(F.lit(-1), F.lit(1))
    grid = landmarks.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"cx": F.floor(F.col("lx") / reach) + F.col("dx"), "cy": F.floor(F.col("ly") / reach) + F.col("dy")})
    drawn = pixels.where("gen = 1").withColumns({"cx": F.floor(F.col("px") / reach), "cy": F.floor(F.col("py") / reach)})
    hit = grid.join(drawn.select("scene", "cx", "cy", "px", "py"), ["scene", "cx", "cy"]).where((F.abs(F.col("px") - F.col("lx")) <= reach) & (F.abs(F.col("py") - F.col("ly")) <= reach)).select("landmark_id").distinct().withColumn("hit", F.lit(1))
    return landmarks.join(hit, "landmark_id", "left").groupBy("scene").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("accuracy"))


def win_rate(votes: DataFrame) -> DataFrame:
    """Wins, losses, ties and win rate (ties count half), per scene and over all (scene NULL)."""
    return votes.sparkSession.sql("""
        SELECT scene, count_if(outcome = 'with') AS wins, count_if(outcome = 'without') AS losses, count_if(outcome = 'tie') AS ties,
               (count_if(outcome = 'with') + 0.5D * count_if(outcome = 'tie')) / count(*) AS rate
        FROM {votes} GROUP BY GROUPING SETS ((scene), ())""", votes=votes)


def prompt_cache(prompts: DataFrame) -> DataFrame:
    """One embedding key per distinct prompt, joined back to every use of it."""
    known = prompts.groupBy("prompt").agg(F.count("*").alias("n_uses"), F.min("prompt_id").alias("first_id")).withColumn("embedding_key", F.md5("prompt"))
    return prompts.join(known, "prompt").select("prompt_id", "embedding_key", "first_id", "n_uses")


def bundle_violations(bundles: DataFrame, version: str = "1.0", size: int = 1024, dims: int = 768) -> DataFrame:
    """One row per broken rule of a bundle's metadata."""
    rules = [
        ("version", F.col("version") != version),
        ("shape", (F.col("height") != size) | (F.col("width") != size)),
        ("dtype", ~F.col("dtype").isin("float32", "uint8")),
        ("embedding", F.col("embedding_dims") != dims),
    ]
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules)), lambda x: x.isNotNull())
    return bundles.select("bundle_id", F.explode(broken).alias("rule"))


def ab_violations(runs: DataFrame) -> DataFrame:
    """Pairs whose runs differ in seed, pose or prompt."""
    n = {c: F.count_distinct(c) for c in ("seed", "pose", "prompt")}
    return runs.groupBy("pair_id").agg(*(v.alias(f"n_{c}") for c, v in n.items())).where("n_seed > 1 OR n_pose > 1 OR n_prompt > 1")


def top_poses(poses: DataFrame, k: int = 5) -> DataFrame:
    """The k best poses of each image; repeated (image, pose) runs count once, with their best score."""
    best = poses.groupBy("image_id", "pose_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("score").desc(), "pose_id")))
    return ranked.where(F.col("rank") <= k)


def default_radius(kind: str = "view") -> Column:
    """80 m for street views, 200 m for elevated ones, 150 m otherwise."""
    return F.when(F.col(kind) == "street", F.lit(80.0)).when(F.col(kind) == "elevated", F.lit(200.0)).otherwise(F.lit(150.0))

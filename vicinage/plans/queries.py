"""Queries over whole tables, one per operator, with the oracle's SQL beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions import geo, polygon, tags
from vicinage.operators import cells, evaluation, images, layers, sampling
from vicinage.plans import oracle as o
from vicinage.plans import retrieval
from vicinage.plans.fixtures import features, view
from vicinage.sources import cache

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SAMPLE_K, DENSE_K = 40, 15
QUAD_CAP = 40


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def rnd(x: Column | str, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def zero() -> Column:
    return F.lit(0.0)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_capture").where("lat is not null").join(view(spark, sf_dir, "geo_query"), "qid")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.parse(images.dedup_by_id(view(spark, sf_dir, "raw_capture")), view(spark, sf_dir, "geo_query"))


LOCATED = "located AS (SELECT c.*, q.lat0, q.lon0, q.radius_m FROM raw_capture c JOIN geo_query q USING (qid) WHERE lat IS NOT NULL)"
BASE = [*o.fixture("geo_query", "raw_capture"), LOCATED]


@query(o.ctes(*BASE, o.enu_cte("p", "located", ele="(arrival % 50)::DOUBLE")) + f"SELECT arrival, {o.rnd('e', 4)} AS e, {o.rnd('n', 4)} AS n, {o.rnd('u', 4)} AS u FROM p")
def enu_project(spark, sf_dir):
    e, n, u = geo.to_enu(F.col("lat"), F.col("lon"), (F.col("arrival") % 50).cast("double"), F.col("lat0"), F.col("lon0"), zero())
    return located(spark, sf_dir).select("arrival", rnd(e, 4).alias("e"), rnd(n, 4).alias("n"), rnd(u, 4).alias("u"))


@query(o.ctes(*BASE) + f"SELECT arrival, {o.rnd('lat', 8)} AS lat, {o.rnd('lon', 8)} AS lon, {o.rnd('(arrival % 50)::DOUBLE', 3)} AS ele FROM located")
def enu_roundtrip(spark, sf_dir):
    origin = F.col("lat0"), F.col("lon0"), zero()
    there = located(spark, sf_dir).select("*", F.struct(*(c.alias(k) for c, k in zip(geo.to_enu(F.col("lat"), F.col("lon"), (F.col("arrival") % 50).cast("double"), *origin), "enu", strict=True))).alias("p"))
    lat, lon, ele = geo.from_enu(F.col("p.e"), F.col("p.n"), F.col("p.u"), *origin)
    return there.select("arrival", rnd(lat, 8).alias("lat"), rnd(lon, 8).alias("lon"), rnd(ele, 3).alias("ele"))


@query(o.ctes(*BASE) + f"SELECT arrival, {o.rnd(o.haversine('lat0', 'lon0', 'lat', 'lon'), 4)} AS dist_m FROM located")
def haversine(spark, sf_dir):
    return located(spark, sf_dir).select("arrival", rnd(geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 4).alias("dist_m"))


BOX = "box AS (SELECT qid, lon0 - radius_m / (111000e0 * cos(radians(lat0))) AS w, lat0 - radius_m / 111000e0 AS s, lon0 + radius_m / (111000e0 * cos(radians(lat0))) AS e, lat0 + radius_m / 111000e0 AS n FROM geo_query)"


@query(o.ctes(*o.fixture("geo_query"), BOX) + f"SELECT qid, {', '.join(f'{o.rnd(c, 8)} AS {c}' for c in 'wsen')} FROM box")
def radius_bbox(spark, sf_dir):
    box = view(spark, sf_dir, "geo_query").select("qid", geo.radius_box(F.col("lat0"), F.col("lon0"), F.col("radius_m")).alias("b"))
    return box.select("qid", *(rnd(F.col(f"b.{c}"), 8).alias(c) for c in "wsen"))


@query(o.ctes(*o.fixture("geo_query"), BOX) + f"SELECT qid, i::INTEGER AS i, j::INTEGER AS j, {o.rnd('w + j * (e - w) / 3', 8)} AS w, {o.rnd('s + i * (n - s) / 3', 8)} AS s, {o.rnd('w + (j + 1) * (e - w) / 3', 8)} AS e, {o.rnd('s + (i + 1) * (n - s) / 3', 8)} AS n FROM box, range(3) a(i), range(3) b(j)")
def bbox_split(spark, sf_dir):
    box = view(spark, sf_dir, "geo_query").select("qid", geo.radius_box(F.col("lat0"), F.col("lon0"), F.col("radius_m")).alias("bbox"))
    return geo.split_box(box).select("qid", "i", "j", *(rnd(F.col(f"cell.{c}"), 8).alias(c) for c in "wsen"))


@query(o.ctes(*o.fixture("geo_query", "raw_capture")) + f"SELECT arrival, {o.rnd('8e0 * cos(radians(90 - compass))', 4)} AS dx, {o.rnd('8e0 * sin(radians(90 - compass))', 4)} AS dy FROM raw_capture WHERE compass IS NOT NULL")
def heading_vector(spark, sf_dir):
    dx, dy = geo.heading_vector(F.col("compass"))
    return view(spark, sf_dir, "raw_capture").where("compass is not null").select("arrival", rnd(dx, 4).alias("dx"), rnd(dy, 4).alias("dy"))


@query(o.ctes(*o.fixture("geo_query")) + f"SELECT qid, k::INTEGER AS k, {o.rnd('radius_m * cos(k / 359e0 * 2 * pi())', 4)} AS e, {o.rnd('radius_m * sin(k / 359e0 * 2 * pi())', 4)} AS n FROM geo_query, range(360) r(k)")
def radius_circle(spark, sf_dir):
    return layers.radius_circle(view(spark, sf_dir, "geo_query")).select("qid", "k", rnd("e", 4).alias("e"), rnd("n", 4).alias("n"))


def _footprints(spark, sf_dir) -> DataFrame:
    return retrieval.footprints(features(spark, sf_dir), view(spark, sf_dir, "geo_query"))


@query(o.ctes(*o.footprint_ctes()) + f"SELECT qid, osm_id, {o.rnd('area_m2', 3)} AS area_m2 FROM measure")
def footprint_area(spark, sf_dir):
    return _footprints(spark, sf_dir).select("qid", "osm_id", rnd("area_m2", 3).alias("area_m2"))


@query(o.ctes(*o.footprint_ctes()) + f"SELECT qid, osm_id, {o.rnd('ce', 3)} AS ce, {o.rnd('cn', 3)} AS cn FROM measure")
def footprint_centroid(spark, sf_dir):
    c = _footprints(spark, sf_dir).select("qid", "osm_id", polygon.centroid(F.col("footprint")).alias("c"))
    return c.select("qid", "osm_id", rnd(F.col("c.e"), 3).alias("ce"), rnd(F.col("c.n"), 3).alias("cn"))


@query(o.ctes(*o.footprint_ctes()) + f"SELECT osm_id, k::INTEGER AS k, {o.rnd('e', 4)} AS e, {o.rnd('n', 4)} AS n FROM enu")
def footprint_project(spark, sf_dir):
    return _footprints(spark, sf_dir).select("osm_id", F.posexplode("footprint").alias("k", "p")).select("osm_id", "k", rnd(F.col("p.e"), 4).alias("e"), rnd(F.col("p.n"), 4).alias("n"))


@query(o.ctes(*o.footprint_ctes()) + f"SELECT osm_id, part::INTEGER AS part, {o.rnd('min(lon)', 8)} AS west, {o.rnd('min(lat)', 8)} AS south, count(*) AS n_vertices FROM ring GROUP BY ALL")
def multipoly_largest(spark, sf_dir):
    f = features(spark, sf_dir).where(F.col("geom_type").isin(*retrieval.POLYGONS)).withColumn("ring", polygon.largest_part(F.col("parts")))
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    return f.select("osm_id", (F.array_position("parts", F.col("ring")) - 1).cast("int").alias("part"), rnd(low("lon"), 8).alias("west"), rnd(low("lat"), 8).alias("south"), F.size("ring").cast("long").alias("n_vertices"))


@query(o.ctes(*o.footprint_ctes()) + "SELECT qid, osm_id FROM measure WHERE area_m2 >= 200")
def area_filter(spark, sf_dir):
    return retrieval.buildings(features(spark, sf_dir), view(spark, sf_dir, "geo_query"), 200.0).select("qid", "osm_id")


@query(o.ctes(*o.fixture("raw_feature")) + "SELECT osm_id, geom_type FROM raw_feature WHERE geom_type IN ('Polygon', 'MultiPolygon')")
def geom_filter(spark, sf_dir):
    return view(spark, sf_dir, "raw_feature").where(F.col("geom_type").isin(*retrieval.POLYGONS)).select("osm_id", "geom_type")


HEIGHTS = o.ctes(*o.fixture("raw_feature"), o.HEIGHT)


@query(HEIGHTS + f"SELECT osm_id, {o.rnd('tag_m', 4)} AS height_m FROM height")
def height_parse(spark, sf_dir):
    return view(spark, sf_dir, "raw_feature").select("osm_id", rnd(tags.height_m(F.col("height_tag")), 4).alias("height_m"))


@query(HEIGHTS + "SELECT osm_id, levels FROM height")
def levels_parse(spark, sf_dir):
    return view(spark, sf_dir, "raw_feature").select("osm_id", tags.levels(F.col("levels_tag")).alias("levels"))


@query(HEIGHTS + f"SELECT osm_id, {o.rnd('height_m', 4)} AS height_m, height_source FROM height_of")
def height_extract(spark, sf_dir):
    h, s = tags.height_with_source(F.col("height_tag"), F.col("levels_tag"))
    return view(spark, sf_dir, "raw_feature").select("osm_id", rnd(h, 4).alias("height_m"), s.alias("height_source"))


BUILT = [*o.footprint_ctes(), o.HEIGHT, "built AS (SELECT h.qid, h.osm_id, m.area_m2, h.height_m, h.height_source, coalesce(h.building, 'yes') AS building_type FROM measure m JOIN height_of h USING (osm_id) WHERE m.area_m2 >= 20)"]


def built(spark, sf_dir) -> DataFrame:
    return retrieval.buildings(features(spark, sf_dir), view(spark, sf_dir, "geo_query"))


@query(o.ctes(*BUILT) + f"SELECT qid, osm_id, {o.rnd('area_m2', 3)} AS area_m2, {o.rnd('height_m', 4)} AS height_m, height_source, building_type FROM built")
def buildings(spark, sf_dir):
    return built(spark, sf_dir).select("qid", "osm_id", rnd(polygon.area(F.col("footprint")), 3).alias("area_m2"), rnd("height_m", 4).alias("height_m"), "height_source", "building_type")


@query(o.ctes(*BUILT) + "SELECT qid, count(*) FILTER (height_source = 'tag') AS n_tag, count(*) FILTER (height_source = 'levels') AS n_levels, count(*) FILTER (height_source = 'none') AS n_none FROM built GROUP BY qid")
def height_summary(spark, sf_dir):
    return layers.height_summary(built(spark, sf_dir))


@query(o.ctes(*BUILT) + "SELECT qid, osm_id, height_m IS NOT NULL AS has_height FROM built")
def has_flags(spark, sf_dir):
    return built(spark, sf_dir).select("qid", "osm_id", F.col("height_m").isNotNull().alias("has_height"))


@query(o.ctes(*o.fixture("geo_query", "raw_capture"), o.DEDUP) + "SELECT qid, raw_id, arrival FROM once")
def image_dedup(spark, sf_dir):
    return images.dedup_by_id(view(spark, sf_dir, "raw_capture")).select("qid", "raw_id", "arrival")


@query(o.ctes(*o.image_ctes()) + f"SELECT qid, raw_id AS image_id, {o.rnd('e', 4)} AS e, {o.rnd('n', 4)} AS n, compass AS compass_deg, captured_ms FROM img")
def image_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select("qid", "image_id", rnd("e", 4).alias("e"), rnd("n", 4).alias("n"), "compass_deg", F.unix_millis("captured_at").alias("captured_ms"))


@query(o.ctes(*o.fixture("geo_query", "raw_capture"), o.DEDUP) + "SELECT qid, count(*) AS n_rows, count(*) >= 350 AS limit_reached FROM once GROUP BY qid")
def limit_flag(spark, sf_dir):
    return cells.over_limit(images.dedup_by_id(view(spark, sf_dir, "raw_capture")), limit=350)


@query(o.ctes(*BASE) + "SELECT arrival, qid FROM (SELECT *, row_number() OVER (PARTITION BY qid, lat >= lat0, lon >= lon0 ORDER BY arrival) AS k FROM located) WHERE k <= 50")
def cell_limit(spark, sf_dir):
    cut = located(spark, sf_dir).withColumns({"north": F.col("lat") >= F.col("lat0"), "east": F.col("lon") >= F.col("lon0")})
    return cells.first_per_cell(cut, ["qid", "north", "east"], ["arrival"], 50).select("arrival", "qid")


@query(o.ctes(*o.image_ctes()) + "SELECT qid, count(compass) AS n_oriented, count(*) - count(compass) AS n_unoriented FROM img GROUP BY qid")
def compass_summary(spark, sf_dir):
    return layers.compass_summary(parsed(spark, sf_dir))


@query(o.ctes(*o.image_ctes()) + "SELECT q.qid, count(i.qid) AS n_images, count(i.qid) >= 340 AS covered FROM geo_query q LEFT JOIN img i ON i.qid = q.qid GROUP BY q.qid")
def coverage(spark, sf_dir):
    return images.coverage(parsed(spark, sf_dir), view(spark, sf_dir, "geo_query"), 340)


@query(o.ctes(*o.image_ctes(), *o.sample_ctes(SAMPLE_K)) + "SELECT qid, rank, image_id FROM chosen")
def fps_sample(spark, sf_dir):
    return sampling.sample(parsed(spark, sf_dir), SAMPLE_K, None).select("qid", "rank", "image_id")


@query(o.ctes(*o.image_ctes(), *o.sample_ctes(DENSE_K)) + "SELECT qid, rank, image_id FROM chosen")
def fps_sample_native(spark, sf_dir):
    return sampling.sample_hof(parsed(spark, sf_dir), DENSE_K)


@query(o.ctes(*o.image_ctes(), *o.sample_ctes(SAMPLE_K, 60.0)) + "SELECT qid, rank, image_id FROM chosen")
def fps_minsep(spark, sf_dir):
    return sampling.sample(parsed(spark, sf_dir), SAMPLE_K, None, min_separation=60.0).select("qid", "rank", "image_id")


def _quad_sql() -> str:
    unit = "unit AS (SELECT l.qid, (lon - w) / (e - w) AS fx, (lat - s) / (n - s) AS fy FROM located l JOIN box USING (qid)), inside AS (SELECT * FROM unit WHERE fx >= 0 AND fx < 1 AND fy >= 0 AND fy < 1)"
    counts = ", ".join(f"count(*) OVER (PARTITION BY qid, floor(fx * {2**k}), floor(fy * {2**k})) AS n{k}" for k in range(5))
    level = "CASE " + " ".join(f"WHEN n{k} <= {QUAD_CAP} THEN {k}" for k in range(5)) + " END"
    return o.ctes(*BASE, BOX, unit, f"counted AS (SELECT *, {counts} FROM inside)", f"levelled AS (SELECT *, {level} AS level FROM counted)") + "SELECT qid, level, floor(fx * (1 << level))::INTEGER AS cx, floor(fy * (1 << level))::INTEGER AS cy, count(*) AS n_rows FROM levelled WHERE level IS NOT NULL GROUP BY ALL"


@query(_quad_sql())
def quadtree_cells(spark, sf_dir):
    return cells.quadtree(view(spark, sf_dir, "raw_capture").where("lat is not null"), view(spark, sf_dir, "geo_query"), QUAD_CAP)


@query(o.ctes(*BASE) + f"SELECT q.qid AS near_qid, c.arrival, {o.rnd(o.haversine('q.lat0', 'q.lon0', 'c.lat', 'c.lon'), 4)} AS dist_m FROM raw_capture c JOIN geo_query q ON {o.haversine('q.lat0', 'q.lon0', 'c.lat', 'c.lon')} <= 100 WHERE c.lat IS NOT NULL")
def range_join(spark, sf_dir):
    near = view(spark, sf_dir, "geo_query").withColumnRenamed("qid", "near_qid").withColumn("radius_m", F.lit(100.0))
    found = cells.range_join(near, view(spark, sf_dir, "raw_capture").where("lat is not null").select("arrival", "lat", "lon"))
    return found.select("near_qid", "arrival", rnd("dist_m", 4).alias("dist_m"))


@query(o.ctes(*o.image_ctes(), *o.sample_ctes(SAMPLE_K), *o.fixture("thumb")) + f"SELECT c.qid, c.rank, c.image_id, {o.rnd('i.e', 4)} AS e, {o.rnd('i.n', 4)} AS n, coalesce(t.url, '') AS thumb_url, CASE WHEN t.url IS NOT NULL THEN concat('thumbnails/', c.image_id, '.jpg') END AS thumb_path FROM chosen c JOIN img i ON i.qid = c.qid AND i.raw_id = c.image_id LEFT JOIN thumb t ON t.image_id = c.image_id")
def street_images(spark, sf_dir):
    got = retrieval.street_images(view(spark, sf_dir, "raw_capture"), view(spark, sf_dir, "geo_query"), view(spark, sf_dir, "thumb"), SAMPLE_K, None)
    return got.select("qid", "rank", "image_id", rnd("e", 4).alias("e"), rnd("n", 4).alias("n"), "thumb_url", "thumb_path")


QUERIES["images"], ORACLE_SQL["images"] = QUERIES.pop("street_images"), ORACLE_SQL.pop("street_images")


@query(o.ctes(*BUILT) + "SELECT qid, osm_id, CASE height_source WHEN 'tag' THEN '#3b5998' WHEN 'levels' THEN '#7ba7d4' ELSE '#c8c8c8' END AS colour FROM built")
def layer_buildings(spark, sf_dir):
    return layers.building_layer(built(spark, sf_dir)).select("qid", "osm_id", "colour")


@query(o.ctes(*o.image_ctes()) + f"SELECT qid, raw_id AS image_id, {o.rnd('8e0 * cos(radians(90 - compass))', 4)} AS dx, {o.rnd('8e0 * sin(radians(90 - compass))', 4)} AS dy, CASE WHEN compass IS NULL THEN '#8ab78f' ELSE '#2e9949' END AS colour FROM img")
def layer_images(spark, sf_dir):
    return layers.image_layer(parsed(spark, sf_dir)).select("qid", "image_id", rnd("dx", 4).alias("dx"), rnd("dy", 4).alias("dy"), "colour")


@query(o.ctes(*o.fixture("geo_query", "raw_capture", "raw_feature"), o.VERTICES, o.enu_cte("enu", "ring"), o.MEASURES, o.DEDUP, o.PLACED, o.enu_cte("img", "placed"), "far AS (SELECT e.qid, greatest(abs(e), abs(n)) AS d FROM enu e JOIN measure USING (osm_id) WHERE area_m2 >= 20 UNION ALL SELECT qid, greatest(abs(e), abs(n)) FROM img)") + f"SELECT q.qid, {o.rnd('1.1e0 * greatest(max(d), any_value(q.radius_m))', 3)} AS half_side FROM geo_query q LEFT JOIN far ON far.qid = q.qid GROUP BY q.qid")
def extent(spark, sf_dir):
    out = layers.extent(view(spark, sf_dir, "geo_query"), built(spark, sf_dir), parsed(spark, sf_dir))
    return out.select("qid", rnd("half_side", 3).alias("half_side"))


@query(o.ctes(*o.image_ctes()) + "SELECT qid, 'raw' AS step, count(*) AS n_rows FROM raw_capture GROUP BY qid UNION ALL SELECT qid, 'unique', count(*) FROM once GROUP BY qid UNION ALL SELECT qid, 'parsed', count(*) FROM img GROUP BY qid UNION ALL SELECT qid, 'sampled', least(count(*), 40) FROM img GROUP BY qid")
def stage_metrics(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_capture")
    unique = images.dedup_by_id(raw)
    good = images.parse(unique, view(spark, sf_dir, "geo_query"))
    return layers.step_counts({"raw": raw, "unique": unique, "parsed": good, "sampled": sampling.sample(good, SAMPLE_K)})


@query(o.ctes(*o.fixture("geo_query"), "place AS (SELECT qid, printf('%.4f_%.4f_r%d', lat0, lon0, trunc(radius_m)::BIGINT) AS p FROM geo_query)") + "SELECT qid, concat('osm_buildings_', p, '_', substr(md5(concat('osm_buildings_', p)), 1, 8)) AS building_key, concat('raw_', p) AS image_key FROM place")
def cache_key(spark, sf_dir):
    at = (F.col("lat0"), F.col("lon0"), F.col("radius_m"))
    return view(spark, sf_dir, "geo_query").select("qid", cache.building_key_column(*at).alias("building_key"), cache.image_key_column(*at).alias("image_key"))


@query(o.ctes(*o.fixture("feature_source")) + "SELECT feature_id, arg_min(source, r) AS source, arg_min(height, r) AS height FROM (SELECT *, list_position(['survey', 'lidar', 'lod2', 'lod1'], source) AS r FROM feature_source) GROUP BY feature_id")
def source_priority(spark, sf_dir):
    return evaluation.by_priority(view(spark, sf_dir, "feature_source")).select("feature_id", "source", "height")


@query(o.ctes(*o.fixture("layer")) + "SELECT layer_id, source, CASE source WHEN 'osm' THEN 'ODbL' WHEN 'usgs' THEN 'public domain' WHEN 'mapillary' THEN 'CC-BY-SA' END AS license FROM layer")
def license_join(spark, sf_dir):
    return evaluation.with_license(view(spark, sf_dir, "layer"))


@query(o.ctes(*o.fixture("geo_query", "raw_capture")) + "SELECT qid, arrival FROM raw_capture WHERE NOT is_pano")
def image_filter(spark, sf_dir):
    return evaluation.usable_images(view(spark, sf_dir, "raw_capture")).select("qid", "arrival")


@query(o.ctes(*o.image_ctes()) + f"SELECT qid, raw_id AS image_id, rank, {o.rnd('d', 4)} AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, raw_id)::INTEGER AS rank FROM (SELECT *, sqrt(e * e + n * n) AS d FROM img) WHERE d <= 100) WHERE rank <= 20")
def nearest_images(spark, sf_dir):
    return images.nearest(parsed(spark, sf_dir)).select("qid", "image_id", "rank", rnd("dist_m", 4).alias("dist_m"))


def _refs(spark, sf_dir) -> DataFrame:
    return images.dedup_by_id(view(spark, sf_dir, "raw_capture")).select("qid", F.col("raw_id").alias("image_id"), "confidence", "sequence_id")


DEDUPED = [*o.fixture("geo_query", "raw_capture"), o.DEDUP]


@query(o.ctes(*DEDUPED) + "SELECT q.qid, r.raw_id AS image_id, r.confidence FROM geo_query q LEFT JOIN once r ON r.qid = q.qid AND r.confidence >= 0.97e0")
def aligned_refs(spark, sf_dir):
    return evaluation.aligned(view(spark, sf_dir, "geo_query"), _refs(spark, sf_dir), 0.97)


@query(o.ctes(*DEDUPED) + "SELECT qid, confidence, raw_id AS image_id FROM once QUALIFY row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, raw_id) = 1")
def top1_ref(spark, sf_dir):
    return evaluation.best_reference(_refs(spark, sf_dir))


@query(o.ctes(*DEDUPED) + "SELECT qid, raw_id AS image_id, CASE WHEN sequence_id % 5 = 0 THEN 'heldout' ELSE 'train' END AS split FROM once")
def heldout_split(spark, sf_dir):
    return evaluation.holdout(_refs(spark, sf_dir)).select("qid", "image_id", "split")


@query(o.ctes(*DEDUPED) + "SELECT sequence_id, count(*) FILTER (arrival % 5 = 0) AS n_heldout, count(*) FILTER (arrival % 5 <> 0) AS n_train FROM once GROUP BY sequence_id HAVING n_heldout > 0 AND n_train > 0")
def leak_check(spark, sf_dir):
    """A split by row instead of by sequence, which must be found to leak."""
    by_row = images.dedup_by_id(view(spark, sf_dir, "raw_capture")).withColumn("split", F.when(F.col("arrival") % 5 == 0, F.lit("heldout")).otherwise(F.lit("train")))
    return evaluation.leaks(by_row)


@query(o.ctes(*o.fixture("mask_pixel")) + f"SELECT scene, sum(gt & gen)::BIGINT AS n_both, sum(gt | gen)::BIGINT AS n_either, {o.rnd('sum(gt & gen) / sum(gt | gen)', 6)} AS iou FROM mask_pixel GROUP BY scene")
def silhouette_iou(spark, sf_dir):
    return evaluation.silhouette_iou(view(spark, sf_dir, "mask_pixel")).select("scene", "n_both", "n_either", rnd("iou", 6).alias("iou"))


@query(o.ctes(*o.fixture("mask_pixel"), "a AS (SELECT scene, px, min(py) AS y FROM mask_pixel WHERE gt = 1 GROUP BY 1, 2), b AS (SELECT scene, px, min(py) AS y FROM mask_pixel WHERE gen = 1 GROUP BY 1, 2)", "g AS (SELECT a.scene, s AS shift, avg(abs(a.y - b.y)) AS error FROM range(-8, 9) r(s) JOIN b ON true JOIN a ON a.scene = b.scene AND a.px = b.px + s GROUP BY 1, 2)") + f"SELECT scene, shift::INTEGER AS shift, {o.rnd('error', 6)} AS error FROM g QUALIFY row_number() OVER (PARTITION BY scene ORDER BY error, abs(shift), shift) = 1")
def skyline_error(spark, sf_dir):
    return evaluation.skyline_error(view(spark, sf_dir, "mask_pixel")).select("scene", "shift", rnd("error", 6).alias("error"))


@query(o.ctes(*o.fixture("mask_pixel", "landmark")) + f"SELECT scene, count(*) AS n, {o.rnd('avg(hit)', 6)} AS accuracy FROM (SELECT l.scene, (EXISTS (SELECT 1 FROM mask_pixel p WHERE p.scene = l.scene AND p.gen = 1 AND abs(p.px - l.lx) <= 3 AND abs(p.py - l.ly) <= 3))::INTEGER AS hit FROM landmark l) GROUP BY scene")
def landmark_accuracy(spark, sf_dir):
    return evaluation.landmark_accuracy(view(spark, sf_dir, "landmark"), view(spark, sf_dir, "mask_pixel")).select("scene", "n", rnd("accuracy", 6).alias("accuracy"))


@query(o.ctes(*o.fixture("vote")) + f"SELECT scene, count(*) FILTER (outcome = 'with') AS wins, count(*) FILTER (outcome = 'without') AS losses, count(*) FILTER (outcome = 'tie') AS ties, {o.rnd('(count(*) FILTER (outcome = $$with$$) + 0.5e0 * count(*) FILTER (outcome = $$tie$$)) / count(*)', 6)} AS rate FROM vote GROUP BY GROUPING SETS ((scene), ())")
def win_rate(spark, sf_dir):
    return evaluation.win_rate(view(spark, sf_dir, "vote")).withColumn("rate", rnd("rate", 6))


@query(o.ctes(*o.fixture("prompt")) + "SELECT prompt_id, md5(prompt) AS embedding_key, min(prompt_id) OVER w AS first_id, count(*) OVER w AS n_uses FROM prompt WINDOW w AS (PARTITION BY prompt)")
def prompt_dedup(spark, sf_dir):
    return evaluation.prompt_cache(view(spark, sf_dir, "prompt"))


@query(o.ctes(*o.fixture("bundle")) + "SELECT bundle_id, 'version' AS rule FROM bundle WHERE version IS DISTINCT FROM '1.0' UNION ALL SELECT bundle_id, 'shape' FROM bundle WHERE height <> 1024 OR width <> 1024 UNION ALL SELECT bundle_id, 'dtype' FROM bundle WHERE dtype NOT IN ('float32', 'uint8') UNION ALL SELECT bundle_id, 'embedding' FROM bundle WHERE embedding_dims <> 768")
def bundle_violations(spark, sf_dir):
    return evaluation.bundle_violations(view(spark, sf_dir, "bundle"))


@query(o.ctes(*o.fixture("ab_run")) + "SELECT pair_id, count(DISTINCT seed) AS n_seed, count(DISTINCT pose) AS n_pose, count(DISTINCT prompt) AS n_prompt FROM ab_run GROUP BY pair_id HAVING count(DISTINCT seed) > 1 OR count(DISTINCT pose) > 1 OR count(DISTINCT prompt) > 1")
def ab_violations(spark, sf_dir):
    return evaluation.ab_violations(view(spark, sf_dir, "ab_run"))


@query(o.ctes(*o.fixture("pose")) + "SELECT image_id, pose_id, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pose_id)::INTEGER AS rank FROM (SELECT image_id, pose_id, max(score) AS score FROM pose GROUP BY 1, 2) QUALIFY rank <= 5")
def topk_poses(spark, sf_dir):
    return evaluation.top_poses(view(spark, sf_dir, "pose"))


@query(o.ctes(*o.fixture("geo_query")) + "SELECT qid, CASE qid % 3 WHEN 0 THEN 80e0 WHEN 1 THEN 200e0 ELSE 150e0 END AS radius_m FROM geo_query")
def view_radius(spark, sf_dir):
    kinds = view(spark, sf_dir, "geo_query").withColumn("view", F.element_at(F.array(F.lit("street"), F.lit("elevated"), F.lit("any")), F.col("qid") % 3 + 1))
    return kinds.select("qid", evaluation.default_radius().alias("radius_m"))

"""Views on the star-schema tables that stand in for query points, captures, features, pixels and votes.

The SQL text is shared by Spark and the oracle; only the epoch function differs between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_MS, ORACLE_MS = "unix_millis(CAST(ts AS TIMESTAMP))", "epoch_us(ts) // 1000"
VIEWS = {
    "geo_query": """
SELECT CAST(n_nationkey AS INT) AS qid, 47.6062e0 + (n_nationkey % 5 - 2) * 0.01e0 AS lat0,
       -122.3321e0 + (floor(n_nationkey / 5) - 2) * 0.01e0 AS lon0, 150e0 AS radius_m
FROM nation""",
    "raw_capture": """
SELECT e.event_id AS arrival,
       CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 10 = 9 THEN concat('img_', CAST(event_id - 1 AS STRING))
            ELSE concat('img_', CAST(event_id AS STRING)) END AS raw_id,
       q.qid,
       CASE WHEN event_id % 83 = 0 THEN NULL ELSE q.lat0 + ((event_id * 7919) % 1601 - 800) * 0.000001e0 END AS lat,
       CASE WHEN event_id % 83 = 0 THEN NULL ELSE q.lon0 + ((event_id * 104729) % 2401 - 1200) * 0.000001e0 END AS lon,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE ((event_id * 31) % 3600) / 10e0 END AS compass,
       CASE WHEN event_id % 89 = 0 THEN NULL ELSE {ms} END AS captured_ms,
       user_id AS sequence_id, event_id % 7 = 0 AS is_pano, ((event_id * 37) % 1000) / 1000e0 AS confidence
FROM events e JOIN geo_query q ON q.qid = e.event_id % 25""",
    "raw_feature": """
SELECT p_partkey AS osm_id, q.qid,
       CASE WHEN p_partkey % 17 = 0 THEN 'Point' WHEN p_partkey % 13 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type,
       q.lon0 + ((p_partkey * 7919) % 2401 - 1200) * 0.000001e0 AS x0,
       q.lat0 + ((p_partkey * 104729) % 1601 - 800) * 0.000001e0 AS y0,
       (20 + p_size * 8) * 0.000001e0 AS w, (15 + p_size * 5) * 0.000001e0 AS h,
       p_partkey % 3 = 0 AS l_shape,
       CASE p_partkey % 12
         WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN concat(CAST(p_size AS STRING), ' m')
         WHEN 3 THEN concat(CAST(p_size * 3 AS STRING), chr(39)) WHEN 4 THEN concat(CAST(p_size * 3 AS STRING), ' ft')
         WHEN 5 THEN concat('~', CAST(p_size AS STRING)) WHEN 6 THEN 'nan'
         WHEN 7 THEN CAST(p_size * 100 AS STRING) WHEN 8 THEN concat(CAST(p_size AS STRING), ' meters')
         WHEN 9 THEN '' WHEN 10 THEN concat('-', CAST(p_size AS STRING)) ELSE NULL END AS height_tag,
       CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size % 12 AS STRING)
         WHEN 2 THEN concat(CAST(p_size % 12 AS STRING), '.5') WHEN 3 THEN 'tall' ELSE '0' END AS levels_tag,
       lower(p_type) AS building
FROM part JOIN geo_query q ON q.qid = p_partkey % 25""",
    "mask_pixel": """
SELECT CAST(l_orderkey % 20 AS INT) AS scene, CAST(l_partkey % 64 AS INT) AS px, CAST(l_suppkey % 64 AS INT) AS py,
       MAX(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS gt,
       MAX(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS gen
FROM lineitem GROUP BY 1, 2, 3""",
    "thumb": """
SELECT concat('img_', CAST(event_id AS STRING)) AS image_id, concat('https://thumbs.example/', CAST(event_id AS STRING)) AS url
FROM events WHERE event_id % 3 <> 0""",
    "vote": """
SELECT CAST(o_orderkey % 20 AS INT) AS scene, CAST(o_custkey % 20 AS INT) AS rater,
       CASE o_orderstatus WHEN 'F' THEN 'with' WHEN 'O' THEN 'without' ELSE 'tie' END AS outcome
FROM orders""",
    "feature_source": """
SELECT l_orderkey AS feature_id, CASE l_linenumber % 4 WHEN 0 THEN 'survey' WHEN 1 THEN 'lod1' WHEN 2 THEN 'lod2' ELSE 'lidar' END AS source,
       MAX(l_quantity) AS height
FROM lineitem GROUP BY 1, 2""",
    "layer": """
SELECT p_partkey AS layer_id, CASE p_partkey % 4 WHEN 0 THEN 'osm' WHEN 1 THEN 'usgs' WHEN 2 THEN 'mapillary' ELSE 'other' END AS source FROM part""",
    "landmark": """
SELECT s_suppkey AS landmark_id, CAST(s_suppkey % 20 AS INT) AS scene, CAST((s_suppkey * 7) % 64 AS INT) AS lx, CAST((s_suppkey * 13) % 64 AS INT) AS ly
FROM supplier""",
    "prompt": """
SELECT o_orderkey AS prompt_id, concat(o_orderpriority, ' ', o_orderstatus, ' ', CAST(o_custkey % 10 AS STRING)) AS prompt FROM orders""",
    "bundle": """
SELECT p_partkey AS bundle_id, CASE WHEN p_partkey % 11 = 0 THEN '0.9' WHEN p_partkey % 29 = 0 THEN NULL ELSE '1.0' END AS version,
       CASE WHEN p_partkey % 7 = 0 THEN 512 ELSE 1024 END AS height, 1024 AS width,
       CASE WHEN p_partkey % 13 = 0 THEN 'float64' ELSE 'float32' END AS dtype,
       CASE WHEN p_partkey % 17 = 0 THEN 512 ELSE 768 END AS embedding_dims
FROM part""",
    "ab_run": """
SELECT o_custkey AS pair_id, o_custkey % 97 AS seed, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS pose,
       CASE WHEN o_orderkey % 31 = 0 THEN 'b' ELSE 'a' END AS prompt
FROM orders""",
    "pose": """
SELECT l_orderkey % 50 AS image_id, l_partkey % 100 AS pose_id, l_extendedprice AS score FROM lineitem""",
}
NEEDS = {"geo_query": ("nation",), "raw_capture": ("events", "nation"), "raw_feature": ("part", "nation"), "mask_pixel": ("lineitem",), "thumb": ("events",), "vote": ("orders",), "feature_source": ("lineitem",), "layer": ("part",), "landmark": ("supplier",), "prompt": ("orders",), "bundle": ("part",), "ab_run": ("orders",), "pose": ("lineitem",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the Parquet tables of a folder; no temp view outlives the call by name alone."""
    text = VIEWS[name].format(ms=SPARK_MS)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name]}
    ctes = ""
    if name in ("raw_capture", "raw_feature"):
        frames["geo_query"] = view(spark, sf_dir, "geo_query")
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(ctes + text, **{t: f for t, f in frames.items() if f"{{{t}}}" in text})


def _ring(x0, y0, w, h):
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    rectangle = F.array(p(x0, y0), p(x0 + w, y0), p(x0 + w, y0 + h), p(x0, y0 + h), p(x0, y0))
    l_shape = F.array(p(x0, y0), p(x0 + w, y0), p(x0 + w, y0 + h / 2), p(x0 + w / 2, y0 + h / 2), p(x0 + w / 2, y0 + h), p(x0, y0 + h), p(x0, y0))
    return F.when(F.col("l_shape"), l_shape).otherwise(rectangle)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_feature with ``parts``: the exterior ring of each part (a point has none)."""
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    first, second = _ring(x0, y0, w, h), _ring(x0 + w * 2, y0, w / 2, h / 2)
    parts = F.when(F.col("geom_type") == "Polygon", F.array(first)).when(F.col("geom_type") == "MultiPolygon", F.array(first, second))
    return view(spark, sf_dir, "raw_feature").withColumn("parts", parts)

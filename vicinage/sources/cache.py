"""Fetched payloads kept by rounded position and radius, for whole batches of queries at once.

What is fetched by one kind of scan is two Parquet tables under a root: ``rows`` with the payloads, one folder for each
fetch, and ``keys`` with the fetch that each key was last answered by. Both only grow, so a fetch that is cut short leaves nothing that counts,
and a key without rows is an empty result that is known.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _position(lat: float, lon: float, radius_m: float) -> str:
    """Four decimals, about 11 m, on purpose; the radius is cut to whole metres."""
    return f"{lat:.4f}_{lon:.4f}_r{int(radius_m)}"


def building_key(lat: float, lon: float, radius_m: float) -> str:
    key = f"osm_buildings_{_position(lat, lon, radius_m)}"
    return f"{key}_{hashlib.md5(key.encode()).hexdigest()[:8]}"


def image_key(lat: float, lon: float, radius_m: float) -> str:
    return f"raw_{_position(lat, lon, radius_m)}"


def _position_column(lat: Column, lon: Column, radius_m: Column) -> Column:
    return F.format_string("%.4f_%.4f_r%d", lat, lon, radius_m.cast("long"))


def building_key_column(lat: Column, lon: Column, radius_m: Column) -> Column:
    """``building_key`` of a batch of queries."""
    key = F.concat(F.lit("osm_buildings_"), _position_column(lat, lon, radius_m))
    return F.concat_ws("_", key, F.substring(F.md5(key.cast("binary")), 1, 8))


def image_key_column(lat: Column, lon: Column, radius_m: Column) -> Column:
    """``image_key`` of a batch of queries."""
    return F.concat(F.lit("raw_"), _position_column(lat, lon, radius_m))


KeyColumn = Callable[[Column, Column, Column], Column]


class FetchCache:
    """Answers queries (qid, lat0, lon0, radius_m) from the cache and fetches what it doesn't know yet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def known(self, kind: str) -> DataFrame:
        """key and the latest batch that answered it."""
        if not self._there(f"{kind}/keys"):
            return self.spark.createDataFrame([], "key string, batch string")
        return self.spark.read.schema("key string, batch string").parquet(f"{self.root}/{kind}/keys").groupBy("key").agg(F.max("batch").alias("batch"))

    def fetch(self, kind: str, queries: DataFrame, key: KeyColumn, scan: Callable[[DataFrame], DataFrame], use_cache: bool = True) -> DataFrame:
        """The rows of ``scan`` for all queries, with their qid; queries of one key are scanned once.

        ``scan`` takes queries and gives rows with a qid. Without ``use_cache`` every key is fetched anew, and kept.
        """
        keyed = queries.withColumn("key", key(F.col("lat0"), F.col("lon0"), F.col("radius_m")))
        once = keyed.groupBy("key").agg(F.min_by(F.struct(*queries.columns), "qid").alias("q")).select("key", "q.*")
        wanted = once.join(self.known(kind), "key", "left_anti") if use_cache else once
        if not wanted.isEmpty():
            batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
            rows = scan(wanted.drop("key")).join(wanted.select("qid", "key"), "qid").drop("qid")
            rows.write.parquet(f"{self.root}/{kind}/rows/batch={batch}")
            wanted.select("key", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.root}/{kind}/keys")
        if not self._there(f"{kind}/rows"):
            return scan(queries.limit(0))
        rows = self.spark.read.parquet(f"{self.root}/{kind}/rows").join(self.known(kind), ["key", "batch"])
        return keyed.select("qid", "key").join(rows.drop("batch"), "key").drop("key")


def distinct_keys(queries: list[tuple[float, float, float]], key: Callable[[float, float, float], str] = image_key) -> dict[str, tuple[float, float, float]]:
    """One fetch per key: the first query of each."""
    out: dict[str, tuple[float, float, float]] = {}
    for q in queries:
        out.setdefault(key(*q), q)
    return out

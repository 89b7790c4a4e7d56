"""Image captures as a stream: order-safe dedup within a watermark, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_arrivals(captures: DataFrame, time_col: str = "captured_at", late: str = "1 hour") -> DataFrame:
    """Each (query, id) once within the watermark; empty ids are dropped. State is bounded by ``late``."""
    return captures.where(F.col("raw_id") != "").withWatermark(time_col, late).dropDuplicatesWithinWatermark(["qid", "raw_id"])


def counts(captures: DataFrame, width: str = "10 minutes", time_col: str = "captured_at", late: str = "1 hour") -> DataFrame:
    """Captures per query and tumbling window, given once the watermark has passed the window."""
    return captures.withWatermark(time_col, late).groupBy("qid", F.window(time_col, width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("compass").isNotNull()).alias("n_oriented")).select("qid", F.col("w.start").alias("start"), "n", "n_oriented")

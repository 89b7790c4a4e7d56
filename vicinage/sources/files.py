"""Downloads and figure-ready exports."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def download(images: DataFrame, fetch: Callable[[str], bytes], columns: tuple[str, str] = ("thumb_path", "thumb_url")) -> DataFrame:
    """(path, content, ok) of every image with a URL; a download that fails gives ok = false and no content.

    The bytes stay in the plan, so that they are written by Spark to the store of the cluster and a task that runs
    twice leaves no half-written file.
    """
    path, url = columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = []
            for u in pdf[url]:
                try:
                    got.append(fetch(u))
                except Exception:  # noqa: BLE001  one image that fails must not fail the rest
                    got.append(None)
            yield pd.DataFrame({"path": pdf[path], "content": got, "ok": [x is not None for x in got]})

    return images.where(f"{url} <> ''").select(path, url).mapInPandas(run, "path string, content binary, ok boolean")


def fetch_url(url: str, timeout: float = 15.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def lookup(fetch: Callable[[str], str | None], pause: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """images -> (image_id, url), asking ``fetch`` once for each id; an id that fails has an empty URL."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            urls = []
            for image_id in pdf["image_id"]:
                try:
                    urls.append(fetch(image_id) or "")
                except Exception:  # noqa: BLE001  one id that fails must not fail the rest
                    urls.append("")
                time.sleep(pause)
            yield pd.DataFrame({"image_id": pdf["image_id"], "url": urls})

    return lambda images: images.select("image_id").distinct().mapInPandas(run, "image_id string, url string")


class Thumbnails:
    """Downloaded images as a table (path, content) under a root; what is there is not fetched again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def stored(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "path string, content binary")
        return self.spark.read.schema("path string, content binary").parquet(self.root)

    def add(self, images: DataFrame, fetch: Callable[[str], bytes] = fetch_url) -> DataFrame:
        """``images`` with thumb_path only where the file is stored; those missing so far are fetched first."""
        new = images.where("thumb_url <> ''").dropDuplicates(["thumb_path"]).join(self.stored().select(F.col("path").alias("thumb_path")), "thumb_path", "left_anti")
        download(new, fetch).where("ok").select("path", "content").write.mode("append").parquet(self.root)
        have = self.stored().select(F.col("path").alias("thumb_path"), F.lit(True).alias("_have")).distinct()
        marked = images.join(have, "thumb_path", "left")
        return marked.select(*(F.when(F.col("_have"), F.col("thumb_path")).alias(c) if c == "thumb_path" else F.col(c) for c in images.columns))


def export(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Write each table under ``root``/name."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{root.rstrip('/')}/{name}")

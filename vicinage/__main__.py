"""Run the stages for one point, from recorded payloads or live servers, and write plot-ready tables.

python -m vicinage --lat 47.6062 --lon -122.3321 --stage osm --features f.geojson --cache /tmp/cache --out /tmp/out
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.operators import layers
from vicinage.plans import stages
from vicinage.session import build
from vicinage.sources import bronze, cellsource, featuresource
from vicinage.sources.cache import FetchCache
from vicinage.sources.figure import draw
from vicinage.sources.files import Thumbnails, export, lookup


def is_url(place: str) -> bool:
    return place.startswith(("http://", "https://"))


def recorded(items: DataFrame, *columns: str) -> Callable[[DataFrame], DataFrame]:
    """A scan that answers every query with the recorded items."""
    return lambda queries: queries.select("qid").join(items.select(*columns), F.lit(True))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vicinage", description=__doc__.split("\n")[0])
    p.add_argument("--lat", type=float)
    p.add_argument("--lon", type=float)
    p.add_argument("--radius", type=float, default=150.0)
    p.add_argument("--stage", default=stages.ORDER[-1], choices=stages.ORDER)
    p.add_argument("--list-stages", action="store_true")
    p.add_argument("--features", help="GeoJSON file or folder, or the URL of an Overpass server")
    p.add_argument("--images", help="JSON file or folder of image items, or the URL of an image server")
    p.add_argument("--thumb-urls", help="JSON file of lines with image_id and url")
    p.add_argument("--thumb-server", help="URL of a server to ask for the thumbnail of each chosen image")
    p.add_argument("--image-limit", type=int, default=100)
    p.add_argument("--seed", type=int, default=0, help="of the first image of the sample")
    p.add_argument("--cache", help="folder of fetched payloads")
    p.add_argument("--no-cache", action="store_true", help="fetch anew, and keep what comes")
    p.add_argument("--thumbnails", help="folder of the table of downloaded images")
    p.add_argument("--no-download", "--no-thumbnails", action="store_true", help="leave thumb_path empty")
    p.add_argument("--out")
    p.add_argument("--figure", help="SVG file to draw")
    p.add_argument("--title", help="of the figure")
    a = p.parse_args(args)
    if a.list_stages:
        print("\n".join(f"{name}: {text}" for name, text in stages.list_stages()))
        return 0
    if a.lat is None or a.lon is None or not a.out:
        p.error("--lat, --lon and --out are required")
    spark = build()
    queries = spark.createDataFrame([(0, a.lat, a.lon, a.radius)], "qid int, lat0 double, lon0 double, radius_m double")
    sources: dict = {"queries": queries}
    if a.features:
        sources["feature_scan"] = featuresource.scanner(url=a.features) if is_url(a.features) else recorded(bronze.read_feature_items(spark, a.features), "payload")
    if a.images:
        sources["capture_scan"] = cellsource.scanner(url=a.images, access=cellsource.token()) if is_url(a.images) else recorded(bronze.read_image_items(spark, a.images), "arrival", "payload")
    if a.thumb_server:
        sources["thumbs"] = lookup(cellsource.http_thumbnail(a.thumb_server, cellsource.token()), pause=0.05)
    elif a.thumb_urls:
        sources["thumbs"] = spark.read.schema("image_id string, url string").json(a.thumb_urls)
    options = {"image_limit": a.image_limit, "seed": a.seed, "download_thumbnails": not a.no_download, "use_cache": not a.no_cache}
    if a.cache:
        options["cache"] = FetchCache(spark, a.cache)
    if a.thumbnails:
        options["thumbnails"] = Thumbnails(spark, a.thumbnails)
    data = stages.run(a.stage, sources, options)
    out = dict(data.tables)
    if "osm" in out:
        out |= {"layer_buildings": layers.building_layer(out["osm"]), "height_summary": layers.height_summary(out["osm"])}
    if "mapillary" in out:
        out |= {"layer_images": layers.image_layer(out["mapillary"]), "compass_summary": layers.compass_summary(out["mapillary"])}
    if a.figure:
        nothing = spark.createDataFrame([], "qid int, footprint array<struct<e:double,n:double>>, e double, n double")
        size = layers.extent(queries, data.tables.get("osm", nothing), data.tables.get("mapillary", nothing))
        draw(a.figure, queries, size, out.get("layer_buildings"), out.get("layer_images"), title=a.title or "")
    export(out | {"radius_circle": layers.radius_circle(queries)}, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""A Python data source that scans buildings around query points, one input partition for each query.

The transport is a function (lat, lon, radius) -> list of GeoJSON features. ``replay`` serves recorded features, which
tests and offline runs use; ``http_transport`` asks an Overpass server, needs a network and was never run live.
"""

from __future__ import annotations

import json
import math
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vicinage.functions.geo import METRES_PER_DEGREE

Transport = Callable[[float, float, float], list[dict]]


def points_of(geometry: dict) -> Iterator[tuple[float, float]]:
    """All positions of a geometry, whatever its nesting."""
    todo = [geometry.get("coordinates") or []]
    while todo:
        x = todo.pop()
        if len(x) >= 2 and not isinstance(x[0], list):
            yield float(x[0]), float(x[1])
        else:
            todo += [y for y in x if isinstance(y, list)]


def replay(features: list[dict]) -> Transport:
    """A transport over recorded features: those with a vertex in the square of side 2 r, as the server answers."""

    def fetch(lat: float, lon: float, radius_m: float) -> list[dict]:
        high = radius_m / METRES_PER_DEGREE
        wide = high / math.cos(math.radians(lat))
        return [f for f in features if any(abs(x - lon) <= wide and abs(y - lat) <= high for x, y in points_of(f.get("geometry") or {}))]

    return fetch


def overpass_query(lat: float, lon: float, radius_m: float) -> str:
    high = radius_m / METRES_PER_DEGREE
    wide = high / math.cos(math.radians(lat))
    box = f"({lat - high},{lon - wide},{lat + high},{lon + wide})"
    return f'[out:json];(node["building"]{box};way["building"]{box};relation["building"]{box};);out geom;'


def feature_of(element: dict) -> dict | None:
    """An Overpass element as a GeoJSON feature; None if it has no usable geometry."""
    ring = lambda points: [[p["lon"], p["lat"]] for p in points or []]
    if element.get("type") == "node":
        geometry = {"type": "Point", "coordinates": [element["lon"], element["lat"]]}
    elif element.get("type") == "way" and len(element.get("geometry") or []) >= 4:
        geometry = {"type": "Polygon", "coordinates": [ring(element["geometry"])]}
    else:
        outer = [ring(m.get("geometry")) for m in element.get("members", []) if m.get("role") == "outer"]
        closed = [r for r in outer if len(r) >= 4 and r[0] == r[-1]]
        if not closed:
            return None
        geometry = {"type": "MultiPolygon", "coordinates": [[r] for r in closed]}
    return {"type": "Feature", "properties": {**element.get("tags", {}), "osmid": element["id"]}, "geometry": geometry}


def http_transport(url: str, timeout: float = 30.0) -> Transport:
    def fetch(lat: float, lon: float, radius_m: float) -> list[dict]:
        body = urllib.parse.urlencode({"data": overpass_query(lat, lon, radius_m)}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, data=body), timeout=timeout) as answer:
            found = (feature_of(x) for x in json.load(answer).get("elements", []))
            return [f for f in found if f]

    return fetch


class _Around(InputPartition):
    def __init__(self, qid: int, lat: float, lon: float, radius_m: float):
        super().__init__((qid, lat, lon, radius_m))


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.queries = json.loads(options["queries"])
        self.features, self.url = json.loads(options.get("features", "[]")), options.get("url")

    def partitions(self) -> list[InputPartition]:
        return [_Around(int(qid), *map(float, q)) for qid, q in self.queries.items()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        qid, *around = partition.value
        for feature in (http_transport(self.url) if self.url else replay(self.features))(*around):
            yield qid, json.dumps(feature)


class FeatureSource(DataSource):
    """``spark.read.format("building_features")`` with options queries (JSON: qid to [lat, lon, radius]), and features
    (JSON list) or url."""

    @classmethod
    def name(cls) -> str:
        return "building_features"

    def schema(self) -> str:
        return "qid int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return FeatureReader(dict(self.options))


def scanner(**options: str) -> Callable[[DataFrame], DataFrame]:
    """A scan for ``FetchCache``: queries -> (qid, payload). The query points, a list the user gave, go to the plan."""

    def scan(queries: DataFrame) -> DataFrame:
        spark = queries.sparkSession
        spark.dataSource.register(FeatureSource)
        listed = {str(r.qid): [r.lat0, r.lon0, r.radius_m] for r in queries.collect()}
        return spark.read.format("building_features").options(queries=json.dumps(listed), **options).load()

    return scan

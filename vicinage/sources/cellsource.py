"""A Python data source that scans one cell per input partition and splits a cell that fails, as the remote API asks.

The transport is a function (box, limit) -> list of items that raises ``CellTooDense`` where the server would
answer 500. ``replay`` serves recorded items, which tests and offline runs use; ``http_transport`` is the thin live
connector, which needs a network and a token.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vicinage.functions.geo import radius_box

Box = tuple[float, float, float, float]
MAX_DEPTH, ROWS_PER_CELL, FIELDS = 4, 50, "id,geometry,compass_angle,captured_at,sequence,is_pano"


class CellTooDense(Exception):
    """The cell has to be split."""


class ConfigError(RuntimeError):
    """A setting is missing or malformed."""


def split(box: Box, n: int = 2) -> list[Box]:
    """Row-major sub-boxes, south to north and then west to east."""
    w, s, e, north = box
    dx, dy = (e - w) / n, (north - s) / n
    return [(w + j * dx, s + i * dy, w + (j + 1) * dx, s + (i + 1) * dy) for i in range(n) for j in range(n)]


def scan(box: Box, fetch: Callable[[Box, int], list[dict]], limit: int = ROWS_PER_CELL, depth: int = 0, pause: float = 0.0) -> Iterator[dict]:
    """Items of a box; a box that is too dense is split 2 x 2 down to MAX_DEPTH levels and then given up."""
    try:
        yield from fetch(box, limit)
    except CellTooDense:
        if depth < MAX_DEPTH:
            for part in split(box):
                yield from scan(part, fetch, limit, depth + 1, pause)
                if pause:
                    time.sleep(pause)


def replay(items: list[dict], dense: int) -> Callable[[Box, int], list[dict]]:
    """A transport over recorded items: more than ``dense`` in a half-open cell counts as too dense."""

    def fetch(box: Box, limit: int) -> list[dict]:
        w, s, e, n = box
        inside = [x for x in items if w <= x["geometry"]["coordinates"][0] < e and s <= x["geometry"]["coordinates"][1] < n]
        if len(inside) > dense:
            raise CellTooDense
        return inside[:limit]

    return fetch


def token(name: str = "IMAGE_API_TOKEN") -> str:
    """The access token, from the environment of the driver only; it never enters a plan."""
    value = os.environ.get(name, "").strip()
    if not value or value == "your_token_here":
        raise ConfigError(f"{name} is not set")
    if not value.startswith("MLY|"):
        raise ConfigError(f"{name} should start with 'MLY|'")
    return value


def http_transport(url: str, access: str, timeout: float = 30.0) -> Callable[[Box, int], list[dict]]:
    def fetch(box: Box, limit: int) -> list[dict]:
        query = urllib.parse.urlencode({"bbox": ",".join(map(str, box)), "fields": FIELDS, "limit": limit})
        request = urllib.request.Request(f"{url}?{query}", headers={"Authorization": f"OAuth {access}"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer).get("data", [])
        except urllib.error.HTTPError as x:
            if x.code == 500:
                raise CellTooDense from x
            raise

    return fetch


def http_thumbnail(url: str, access: str, field: str = "thumb_256_url", timeout: float = 15.0) -> Callable[[str], str | None]:
    """The URL of one image's thumbnail, by its id."""

    def fetch(image_id: str) -> str | None:
        request = urllib.request.Request(f"{url}/{urllib.parse.quote(image_id)}?fields={field}", headers={"Authorization": f"OAuth {access}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer).get(field)

    return fetch


class _Cell(InputPartition):
    def __init__(self, qid: int, box: Box, number: int):
        super().__init__((qid, box, number))


class CellReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.boxes = json.loads(options["boxes"])
        self.items, self.dense = json.loads(options.get("items", "[]")), int(options.get("dense", "500"))
        self.url, self.access, self.parts = options.get("url"), options.get("access"), int(options.get("parts", "2"))

    def partitions(self) -> list[InputPartition]:
        cells = [(int(qid), cell) for qid, box in self.boxes.items() for cell in split(tuple(box), self.parts)]
        return [_Cell(qid, cell, k) for k, (qid, cell) in enumerate(cells)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        qid, box, number = partition.value
        fetch = http_transport(self.url, self.access or token()) if self.url else replay(self.items, self.dense)
        for k, item in enumerate(scan(tuple(box), fetch, pause=0.05 if self.url else 0.0)):
            yield qid, (number << 32) + k, json.dumps(item)


class CellSource(DataSource):
    """``spark.read.format("image_cells")`` with options boxes (JSON: qid to box), and items + dense, or url. ``arrival`` is the
    order of the cells and of the items in each."""

    @classmethod
    def name(cls) -> str:
        return "image_cells"

    def schema(self) -> str:
        return "qid int, arrival long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return CellReader(dict(self.options))


def scanner(**options: str) -> Callable[[DataFrame], DataFrame]:
    """A scan for a cache: queries -> (qid, arrival, payload). The query points, a list the user gave, go to the plan."""

    def scan(queries: DataFrame) -> DataFrame:
        spark = queries.sparkSession
        spark.dataSource.register(CellSource)
        box = radius_box(F.col("lat0"), F.col("lon0"), F.col("radius_m"))
        boxes = {str(r.qid): list(r.b) for r in queries.select("qid", box.alias("b")).collect()}
        return spark.read.format("image_cells").options(boxes=json.dumps(boxes), **options).load()

    return scan

"""Ordered retrieval stages: each adds one named table to the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.operators.images import parse_json
from vicinage.plans import retrieval
from vicinage.sources.bronze import parse_features
from vicinage.sources.cache import KeyColumn, building_key_column, image_key_column


@dataclass
class StageData:
    """What the stages have given so far; each stage writes its own table only."""

    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Stage:
    name: str
    description: str
    fetch: Callable[[dict, dict], DataFrame]


def _scanned(scan: str, key: KeyColumn, sources: dict, options: dict) -> DataFrame:
    """The payloads of a scan for all queries, through the cache if there is one."""
    if options.get("cache") is None:
        return sources[scan](sources["queries"])
    return options["cache"].fetch(scan, sources["queries"], key, sources[scan], options.get("use_cache", True))


def _buildings(sources: dict, options: dict) -> DataFrame:
    """From ``features``, or from ``feature_scan`` (queries -> qid, payload)."""
    features = sources["features"] if "features" in sources else parse_features(_scanned("feature_scan", building_key_column, sources, options))
    return retrieval.buildings(features, sources["queries"], options.get("min_area_m2", 20.0))


def _images(sources: dict, options: dict) -> DataFrame:
    """From ``captures``, or from ``capture_scan`` (queries -> qid, arrival, payload); thumbnails are stored if asked."""
    if "captures" in sources:
        captures = sources["captures"]
    else:
        captures = parse_json(_scanned("capture_scan", image_key_column, sources, options)).withColumn("sequence_id", F.lit(None).cast("long"))
    chosen = retrieval.street_images(captures, sources["queries"], sources.get("thumbs"), options.get("image_limit", 100), options.get("seed", 0))
    store = options.get("thumbnails")
    if store is not None and "thumbs" in sources and options.get("download_thumbnails", True):
        return store.add(chosen, *options.get("fetch", ()))
    return chosen.withColumn("thumb_path", F.lit(None).cast("string")) if "thumb_path" in chosen.columns and not options.get("download_thumbnails", True) else chosen


REGISTRY = {
    "osm": Stage("osm", "building footprints with heights", _buildings),
    "mapillary": Stage("mapillary", "a diverse sample of street images", _images),
}
ORDER = ("osm", "mapillary")


def stages_up_to(name: str) -> list[Stage]:
    """All stages up to the named one, in order."""
    if name not in REGISTRY:
        raise KeyError(f"Unknown stage {name!r}; known: {', '.join(ORDER)}")
    return [REGISTRY[s] for s in ORDER[: ORDER.index(name) + 1]]


def list_stages() -> list[tuple[str, str]]:
    return [(s, REGISTRY[s].description) for s in ORDER]


def run(name: str, sources: dict, options: dict | None = None) -> StageData:
    """Run the stages up to ``name``; running one again replaces its own table and nothing else."""
    data = StageData()
    for stage in stages_up_to(name):
        data.tables[stage.name] = stage.fetch(sources, options or {})
    return data

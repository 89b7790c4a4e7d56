"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(app: str = "vicinage", master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with ANSI casts and adaptive execution; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()

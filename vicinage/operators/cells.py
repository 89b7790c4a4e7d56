"""Cells: the spatial range join, the adaptive quadtree, and per-cell limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.geo import METRES_PER_DEGREE, haversine_m, radius_box


def range_join(queries: DataFrame, points: DataFrame, cell_deg: float | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points within radius_m of each query, as an equi-join on grid cells instead of a nested loop.

    Each query is expanded to the cells its box touches (a few, as cells are as large as the largest radius unless
    given), each point has one cell; the great-circle test is the residual condition. Adds ``dist_m``.
    """
    largest = queries.agg(F.greatest(F.max("radius_m") / METRES_PER_DEGREE, F.lit(1e-4))).scalar()
    cell = F.lit(cell_deg) if cell_deg else largest
    box = radius_box(F.col("lat0"), F.col("lon0"), F.col("radius_m") * 1.01)
    index = lambda c: F.floor(c / cell).cast("int")
    reach = queries.withColumn("_b", box)
    reach = reach.withColumn("_cx", F.explode(F.sequence(index(F.col("_b.w")), index(F.col("_b.e"))))).withColumn("_cy", F.explode(F.sequence(index(F.col("_b.s")), index(F.col("_b.n"))))).drop("_b")
    placed = points.withColumns({"_cx": index(F.col(lon)), "_cy": index(F.col(lat))})
    found = placed.join(reach, ["_cx", "_cy"]).withColumn("dist_m", haversine_m(F.col("lat0"), F.col("lon0"), F.col(lat), F.col(lon)))
    return found.where(F.col("dist_m") <= F.col("radius_m")).drop("_cx", "_cy")


def quadtree(points: DataFrame, queries: DataFrame, cap: int, depth: int = 4, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cells an adaptive scan returns if a cell of more than ``cap`` rows must be split 2 x 2, to ``depth`` levels.

    One aggregation to the finest cells (partial sums before the shuffle); coarser counts are windows over that
    small table of at most 4**depth cells a query. A row comes back with the first level whose cell fits; rows
    whose finest cell is still too full are given up. Cells are half open, so no row is returned twice.
    Result: qid, level, cx, cy, n_rows.
    """
    side = 2**depth
    b = radius_box(F.col("lat0"), F.col("lon0"), F.col("radius_m"))
    joined = points.join(queries.select("qid", b.alias("_b")), "qid")
    fx = (F.col(lon) - F.col("_b.w")) / (F.col("_b.e") - F.col("_b.w"))
    fy = (F.col(lat) - F.col("_b.s")) / (F.col("_b.n") - F.col("_b.s"))
    inside = joined.where((fx >= 0) & (fx < 1) & (fy >= 0) & (fy < 1))
    finest = inside.groupBy("qid", F.floor(fx * side).cast("int").alias("cx"), F.floor(fy * side).cast("int").alias("cy")).agg(F.count("*").alias("n"))
    at = lambda c, k: F.shiftright(c, depth - k)
    for k in range(depth + 1):
        finest = finest.withColumn(f"n{k}", F.sum("n").over(Window.partitionBy("qid", at("cx", k), at("cy", k))))
    level = F.coalesce(*(F.when(F.col(f"n{k}") <= cap, F.lit(k)) for k in range(depth + 1)))
    kept = finest.withColumn("level", level).where("level is not null")
    cell = lambda c: F.expr(f"shiftright({c}, {depth} - level)").alias(c)
    return kept.groupBy("qid", "level", cell("cx"), cell("cy")).agg(F.sum("n").alias("n_rows"))


def first_per_cell(points: DataFrame, keys: list[str], order: list, limit: int = 50) -> DataFrame:
    """At most ``limit`` rows of each cell, in the given order: the request limit of one scan."""
    return points.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= limit).drop("_k")


def over_limit(points: DataFrame, key: str = "qid", limit: int = 500) -> DataFrame:
    """Rows per query and whether they reach the limit (a warning only; nothing is cut)."""
    return points.groupBy(key).agg(F.count("*").alias("n_rows")).withColumn("limit_reached", F.col("n_rows") >= limit)

"""Farthest-point sampling in position and heading: greedy within a query, parallel across queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION_WEIGHT = 1.0
HEADING_WEIGHT = 0.44  # 45 degrees count as about 20 m


def farthest(e: np.ndarray, n: np.ndarray, compass: np.ndarray, k: int, start: int = 0, min_separation: float | None = None) -> list[int]:
    """Indices in selection order. All of them, in input order, if there are at most ``k``; one at least if there is any.

    Ties go to the first index. With ``min_separation`` the selection ends where the farthest point is nearer.
    """
    size = len(e)
    if size <= k and min_separation is None:
        return list(range(size))
    if not size:
        return []
    heading = np.mod(compass, 360.0)
    chosen, gap = [start], np.full(size, np.inf)
    while len(chosen) < min(k, size):
        last = chosen[-1]
        dx, dy = e - e[last], n - n[last]
        turn = np.abs(heading - heading[last])
        turn = np.nan_to_num(np.minimum(turn, 360.0 - turn), nan=0.0)
        gap = np.minimum(gap, POSITION_WEIGHT * np.sqrt(dx * dx + dy * dy) + HEADING_WEIGHT * turn)
        gap[chosen] = -np.inf
        best = int(np.argmax(gap))
        if min_separation is not None and gap[best] < min_separation:
            break
        chosen.append(best)
    return chosen


def random_start(n: int, seed: int = 0) -> int:
    """The start index of a seeded run, for parity; SQL can't express it, so oracle queries start at the first row."""
    return int(np.random.default_rng(seed).integers(n)) if n else 0


def sample(images: DataFrame, k: int = 100, seed: int | None = 0, min_separation: float | None = None) -> DataFrame:
    """A diverse subset of each query's images with its rank (from 1). With seed None the first arrival starts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival", kind="stable").reset_index(drop=True)
        start = 0 if seed is None else random_start(len(pdf), seed)
        order = farthest(pdf["e"].to_numpy(float), pdf["n"].to_numpy(float), pdf["compass_deg"].to_numpy(float), k, start, min_separation)
        return pdf.iloc[order].assign(rank=np.arange(1, len(order) + 1, dtype=np.int32))

    fields = ", ".join(f"{c} {t}" for c, t in images.dtypes)
    return images.groupBy("qid").applyInPandas(run, f"{fields}, rank int")


def sample_hof(images: DataFrame, k: int) -> DataFrame:
    """The same selection without Python, as a fold over arrays; for small groups (size times k up to about 1e5)."""
    item = F.struct("arrival", "image_id", "e", "n", F.pmod("compass_deg", F.lit(360.0)).alias("c"))
    grouped = images.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("p"))

    def apart(a: Column, b: Column) -> Column:
        dx, dy = a["e"] - b["e"], a["n"] - b["n"]
        turn = F.abs(a["c"] - b["c"])
        return F.sqrt(dx * dx + dy * dy) + HEADING_WEIGHT * F.coalesce(F.least(turn, 360 - turn), F.lit(0.0))

    start = F.struct(F.array(F.lit(1)).alias("sel"), F.transform("p", lambda _: F.lit(float("inf"))).alias("gap"))

    def step(acc: Column, _: Column) -> Column:
        last = F.element_at("p", F.element_at(acc["sel"], -1))
        gaps = F.transform(F.zip_with("p", acc["gap"], lambda x, g: F.least(g, apart(x, last))), lambda g, i: F.when(F.array_contains(acc["sel"], i + 1), F.lit(-float("inf"))).otherwise(g))
        bound = F.transform(F.array(gaps), lambda g: F.struct(F.concat(acc["sel"], F.array(F.array_position(g, F.array_max(g)).cast("int"))).alias("sel"), g.alias("gap")))
        return F.element_at(bound, 1)

    more = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), start, step, lambda acc: acc["sel"]) if k > 1 else F.array(F.lit(1))
    chosen = F.when(F.size("p") <= k, F.sequence(F.lit(1), F.size("p"))).otherwise(more)
    return grouped.select("qid", "p", F.posexplode(chosen).alias("pos", "i")).select("qid", (F.col("pos") + 1).alias("rank"), F.element_at("p", F.col("i"))["image_id"].alias("image_id"))

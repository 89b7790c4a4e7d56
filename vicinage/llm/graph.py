"""Distributed connected components, and streaming over sorted groups of a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import Scratch


def _star(scratch: Scratch, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with the least v of each u; the minima are a table, so a hot u is only a skewed join."""
    least = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    return edges.join(least, "u"), least


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser node, or is the centre of a star, but not both."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("centre")))
    both = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    return both.where("out + centre > 1").isEmpty()


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(id, component) of every id that has an edge to another; component is the least id reachable.

    Alternating large-star and small-star rounds: each hangs a node's neighbours on the least of them, so paths
    halve and the edges end as stars around the least id. Every round is one table in the shared folder; only the
    answer whether stars are all that is left comes back to the driver. Null ids and loops are left out.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = scratch.save(edges, "edges")
    for k in range(most_rounds):
        if _stars_only(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, large = _star(scratch, both, f"least{k}")
        hung = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        hung = scratch.save(hung, f"large{k}")
        joined, small = _star(scratch, hung, f"least{k}s")
        stars = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(stars, f"round{k}")
        scratch.drop(edges, large, hung, small)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns (integers); only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for x in keys:
            change[1:] |= x[1:] != x[:-1]
        change[0] = last is not None and tuple(x[0] for x in keys) != last
        at = 0
        for k in np.flatnonzero(change).tolist():
            if k > at:
                held.append(batch.slice(at, k - at))
            yield pa.Table.from_batches(held)
            held, at = [], k
        held.append(batch.slice(at))
        last = tuple(x[-1] for x in keys)
    if held:
        yield pa.Table.from_batches(held)


def least_labels(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each row's component, by a symmetric boolean matrix."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        low = np.minimum(low, low[order][low])
        if (low == label).all():
            return ids[order][label]
        label = low

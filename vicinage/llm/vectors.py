"""Vector operators: exact top-k inner-product search by ball trees, and cosine near-duplicates by sign hashing."""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.llm.common import Scratch, text_bytes
from vicinage.llm.graph import connected_components, groups, least_labels

EXACT = float(2**53)


def sound(vec: str):
    """Whether a vector takes part: not null, not empty, all components present and finite."""
    c = F.col(vec)
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def packed(df: DataFrame, cols: list[str], vec: str, scale: float | None = None) -> DataFrame:
    """The columns and ``vec`` as little-endian doubles in one binary; floor(scale * x) if a scale is given."""

    def run(batches):
        for batch in batches:
            v = batch.column(len(cols))
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if scale is not None:
                flat = np.floor(flat * scale)
            raw, ends = flat.tobytes(), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]) * 8
            ends = ends.astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(cols))] + [pa.array([raw[i:j] for i, j in zip(ends, ends[1:], strict=False)], pa.binary())], names=[*cols, "vec"])

    schema = ", ".join(f"{c} {t}" for c, t in df.select(*cols).dtypes)
    return df.select(*cols, vec).mapInArrow(run, f"{schema}, vec binary")


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal-length packed vectors."""
    a, offsets = text_bytes(col)
    return np.frombuffer(a.tobytes(), np.float64).reshape(len(col), -1) if len(a) else np.zeros((len(col), 0))


class BallTree:
    """Centres and radii of nested balls over the rows of a matrix; leaves hold ``leaf`` rows at most."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 128):
        order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            part = x[order[lo:hi]]
            centre = part.mean(0)
            radius = math.sqrt(((part - centre) ** 2).sum(1).max())
            me = len(nodes)
            nodes.append([centre, radius, lo, hi, []])
            if parent >= 0:
                nodes[parent][4].append(me)
            if hi - lo > leaf and radius > 0:
                far = part[((part - part[((part - centre) ** 2).sum(1).argmax()]) ** 2).sum(1).argmax()]
                side = part @ (far - centre)
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(side, mid)]
                todo += [(lo, lo + mid, me), (lo + mid, hi, me)]
        self.x, self.ids = x[order], ids[order]
        self.centre, self.radius = np.stack([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.lo, self.hi, self.children = [n[2] for n in nodes], [n[3] for n in nodes], [n[4] for n in nodes]

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int):
        """Yield (query row, ids, scores) of candidates that may be among the k best; ``floors``: known kth scores.

        Best first: the node of the greatest upper bound q.c + |q| r comes next, and the search ends where the
        bound falls below the kth score so far. Equal scores stay in, so that ties go to smaller ids.
        """
        norms = np.sqrt((queries**2).sum(1))
        bounds = queries @ self.centre.T + norms[:, None] * self.radius[None, :]
        bounds += 1e-6 + 1e-9 * (norms[:, None] * (np.sqrt((self.centre**2).sum(1)) + self.radius)[None, :])
        for i, q in enumerate(queries):
            kth, best_s, best_id, bound = floors[i], np.zeros(0), np.zeros(0, np.int64), bounds[i]
            heap = [(-bound[0], 0)]
            while heap:
                up, node = heapq.heappop(heap)
                if -up < kth:
                    break
                if self.children[node]:
                    for c in self.children[node]:
                        if bound[c] >= kth:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                lo, hi = self.lo[node], self.hi[node]
                s = self.x[lo:hi] @ q
                keep = np.flatnonzero((s >= kth) & (self.ids[lo:hi] != own[i]))
                if not len(keep):
                    continue
                best_s, best_id = np.concatenate([best_s, s[keep]]), np.concatenate([best_id, self.ids[lo:hi][keep]])
                order = np.lexsort((best_id, -best_s))
                best_s, best_id = best_s[order], best_id[order]
                first = np.zeros(len(order), bool)
                first[np.unique(best_id, return_index=True)[1]] = True  # of repeated rows, the best
                best_s, best_id = best_s[first][:k], best_id[first][:k]
                if len(best_s) == k:
                    kth = max(kth, best_s[-1])
            yield i, best_id, best_s


def brute(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """The same in unbounded integers, for components so large that doubles would round."""
    xi = [[int(v) for v in row] for row in x]
    for i, q in enumerate(queries):
        q = [int(v) for v in q]
        best: dict[int, int] = {}
        for j, row in zip(ids.tolist(), xi, strict=True):
            if j != own[i]:
                best[j] = max(best.get(j, -(2**200)), sum(a * b for a, b in zip(q, row, strict=True)))
        got = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
        yield i, np.array([p[0] for p in got], np.int64), np.array([min(max(p[1], -(2**63)), 2**63 - 1) for p in got], np.int64)


def _keyed(df: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _build(rows: DataFrame) -> DataFrame:
    """rows: dim, cell, sub, id, vec -> dim, cell, sub, tree (a pickled ball tree), one row for each shard."""

    def run(batches):
        for t in groups(batches, 3):
            tree = BallTree(matrix(t.column(4).combine_chunks()), t.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*(t.column(k).slice(0, 1).combine_chunks() for k in range(3)), pa.array([pickle.dumps(tree)], pa.binary())], names=["dim", "cell", "sub", "tree"])

    keys = ("dim", "cell", "sub")
    return _keyed(rows.select(*keys, "id", "vec"), keys).mapInArrow(run, "dim int, cell int, sub int, tree binary")


def _search(trees: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """trees: dim, cell, sub, tree; asks: dim, cell, sub, block, id, floor, vec -> query_id, vec_id, score.

    A task takes one tree and then the block's queries for it.
    """
    keys = ("dim", "cell", "sub", "block")
    wanted = trees.join(asks.select(*keys).distinct(), ["dim", "cell", "sub"])
    both = wanted.select(*keys, F.lit(0).alias("role"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("floor"), F.col("tree").alias("data"))
    both = both.unionByName(asks.select(*keys, F.lit(1).alias("role"), "id", "floor", F.col("vec").alias("data")))

    def run(batches):
        for t in groups(batches, 4):
            data = t.column(7).combine_chunks()
            tree = pickle.loads(data[0].as_py())
            queries, own, floors = matrix(data.slice(1)), t.column(5).to_numpy()[1:], t.column(6).to_numpy()[1:]
            top = float(np.abs(tree.x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * tree.x.shape[1]
            found = tree.search(queries, own, floors, k) if top < EXACT else brute(tree.x, tree.ids, queries, own, k)
            out = [(np.full(len(got), own[i]), got, np.asarray(s).astype(np.int64)) for i, got, s in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return _keyed(both, keys, "role").mapInArrow(run, "query_id long, vec_id long, score long")


class Cells:
    """Balls around sampled centres, for the vector lengths that have several: what a query needs to choose among them."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        self.radius = {dim: np.zeros(len(c)) for dim, c in centres.items()}

    def assign(self, rows: DataFrame) -> DataFrame:
        """rows: id, dim, vec -> with cell and the distance to its centre."""
        centres = self.centres

        def run(batches):
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    of_dim = batch.filter(pa.array(dims == dim))
                    for lo in range(0, of_dim.num_rows, 256):
                        part = of_dim.slice(lo, 256)
                        cell, far = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
                        if dim in centres:
                            x, c = matrix(part.column(2)), centres[dim]
                            cell = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1).astype(np.int32)
                            far = np.sqrt(((x - c[cell]) ** 2).sum(1))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(far)], names=["id", "dim", "vec", "cell", "far"])

        return rows.select("id", "dim", "vec").mapInArrow(run, "id long, dim int, vec binary, cell int, far double")

    def route(self, asks: DataFrame, lo: int, hi: int) -> DataFrame:
        """asks: id, dim, floor, vec -> a row for each cell whose upper bound is among the ``lo`` th to ``hi`` th of the
        query's and reaches its floor."""
        centres, radius = self.centres, self.radius

        def run(batches):
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    of_dim = batch.filter(pa.array(dims == dim))
                    for at in range(0, of_dim.num_rows, 256):
                        part = of_dim.slice(at, 256)
                        row, cell = np.arange(part.num_rows if not lo else 0), np.zeros(part.num_rows if not lo else 0, np.int64)
                        if dim in centres:
                            x, c, r = matrix(part.column(3)), centres[dim], radius[dim]
                            norms = np.sqrt((x**2).sum(1))[:, None]
                            bounds = x @ c.T + norms * r + 1e-6 + 1e-9 * norms * (np.sqrt((c**2).sum(1)) + r)
                            order = np.argsort(-bounds, axis=1, kind="stable")[:, lo:hi]
                            row, at_ = np.nonzero(np.take_along_axis(bounds, order, 1) >= part.column(2).to_numpy()[:, None])
                            cell = order[row, at_]
                        taken = part.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32))], names=["id", "dim", "floor", "vec", "cell"])

        return asks.select("id", "dim", "floor", "vec").mapInArrow(run, "id long, dim int, floor double, vec binary, cell int")


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, query_rows: int = 1 << 16, most_cells: int = 4096, waves: tuple[int, ...] = (1, 8)) -> DataFrame:
    """The k highest integer inner products of each query among all vectors but its own id: query_id, rank, vec_id, score.

    Components become floor(scale * x). Candidates belong to the nearest of at most ``most_cells`` sampled centres; a
    cell of more than ``shard_rows`` rows (8 MB) is dealt by id into shards. Every shard gets one ball tree, built once
    and stored. A query visits the cells in the order of their upper bounds: first the best one, then the others up to
    the bounds of ``waves``, then the rest; its kth score after each wave is the floor that a cell's and a node's bound
    has to reach in the next. Only the centres and radii of the cells are known to all tasks.

    Null, empty or non-finite vectors and null ids take no part; only vectors of equal length are compared; of
    rows that repeat an id the best counts as candidate and the least vector as query; ties go to smaller ids;
    no rows give no rows. Scores beyond a long are clipped to its range.
    """
    scratch = Scratch(spark, "topk")
    rows = vectors.where(sound(vec_col) & F.col(id_col).isNotNull())
    asks = queries.where(sound(vec_col) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(vec_col).alias(vec_col))
    rows, asks = (scratch.save(packed(x.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), vec_col), ["id", "dim"], vec_col, scale), n) for x, n in ((rows, "rows"), (asks, "queries")))
    n = rows.count()
    large = rows.groupBy("dim").count().where(F.col("count") > shard_rows).orderBy(F.col("count").desc(), "dim").limit(64).collect()
    centres = {}
    for dim, many in large:
        some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(min(-(-many // shard_rows), -(-most_cells * many // n)))
        centres[dim] = np.stack([np.frombuffer(r[0]) for r in some.select("vec").collect()])
    cells = Cells(centres)
    placed = scratch.save(cells.assign(rows), "placed")
    most = F.greatest(F.lit(128), F.least(F.lit(shard_rows), F.floor(F.lit(1 << 20) / F.col("dim"))))
    sizes = scratch.save(placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("parts", F.ceil(F.col("n") / most).cast("int")), "cells")
    for dim, cell, radius in sizes.where(F.col("dim").isin(list(centres))).select("dim", "cell", "radius").collect():
        cells.radius[dim][cell] = radius
    parts = sizes.select("dim", "cell", "parts")
    trees = scratch.save(_build(placed.join(parts, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))), "trees")
    blocks = max(1, -(-asks.count() // query_rows))
    best = None
    edges = [0, *(w for w in waves if w < max(map(len, centres.values()), default=1)), most_cells + 1]
    for lo, hi in zip(edges, edges[1:], strict=False):
        floor = F.lit(-float("inf"))
        known = asks.withColumn("floor", floor)
        if best is not None:
            floors = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
            known = asks.join(floors, "id", "left").withColumn("floor", F.coalesce("kth", floor))
        routed = cells.route(known, lo, hi).join(parts, ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        routed = scratch.save(routed.select("dim", "cell", "sub", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), "id", "floor", "vec"), f"routed{lo}")
        found = _search(trees, routed, k)
        found = found if best is None else found.unionByName(best.select("query_id", "vec_id", "score"))
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        best = scratch.save(ranked.select("query_id", "rank", "vec_id", "score"), f"best{lo}")
        scratch.drop(routed)
    scratch.drop(trees, placed)
    return best


def hash_plan(n: int, threshold: float, recall: float, bucket: int = 64) -> tuple[int, int]:
    """(bits, tables): bits so that random vectors share a bucket with about ``bucket`` others; tables so that a
    pair just at the threshold meets in one of them with probability ``recall``."""
    bits = min(30, max(6, round(math.log2(max(n, 2) / bucket))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def far_bits(threshold: float, bits: int) -> int:
    """More signs than a pair at the threshold ever differs in: five standard deviations above the mean."""
    q = math.acos(threshold) / math.pi
    return math.ceil(bits * q + 5 * math.sqrt(bits * q * (1 - q)))


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999, block: int = 2048, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links of cosine >= threshold: id, n_links, component_id, kept; one row per row of the input.

    Equal vectors become one class with a count. Each class is hashed by the signs of random projections in several
    tables. Signatures alone are dealt to the buckets: a class stays in a bucket if the signs of some other class in
    it, over all tables, are near enough to its own and this is the first table in which both agree. Vectors travel to
    those buckets only and are compared exactly, in doubles, by matrix products over pairs of blocks; a pair counts in
    its first table. No list of pairs is made: a task gives each class a number of links and the least id it is
    linked to. Components come from those edges. Null, empty, zero or non-finite vectors and null ids link with
    nothing; vectors of different lengths don't link; rows that repeat an id count as vectors of their own; no rows
    give no rows.
    """
    scratch = Scratch(spark, "cosine")
    valid = sound(vec_col) & F.col(id_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)
    base = vectors.select(F.col(id_col).alias("id"), F.when(valid, F.col(vec_col)).alias("v"))
    rows = scratch.save(packed(base.where("v is not null"), ["id"], "v").withColumn("key", F.xxhash64("vec")), "rows")
    classes = scratch.save(rows.groupBy("key", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("mult")).withColumn("dim", F.length("vec")), "classes")
    n = classes.count()
    bits, tables = hash_plan(n, threshold, recall)
    limit, powers = far_bits(threshold, bits * tables), 1 << np.arange(bits)

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column(2))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((x.shape[1], bits * tables))
                signs = (x / np.abs(x).max(1, keepdims=True)) @ planes[dim] > 0
                raw = np.packbits(signs, axis=1)
                own = pa.array([r.tobytes() for r in raw], pa.binary())
                sigs = signs.reshape(len(x), tables, bits) @ powers
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), own, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(sigs.ravel().astype(np.int32)))], names=["rep", "dim", "own", "sigs"])

    signed = scratch.save(classes.select("rep", "dim", "vec").mapInArrow(sign, "rep long, dim int, own binary, sigs array<int>"), "signed")
    spread = signed.select("dim", F.posexplode("sigs").alias("t", "sig"), "rep", "own")
    many = spread.groupBy("dim", "t", "sig").count().where(F.col("count") > block).select("dim", "t", "sig", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = spread.join(scratch.save(many, "hot"), ["dim", "t", "sig"], "left")
    mine = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    keys = ("dim", "t", "sig", "lo", "hi")
    dealt = dealt.select("dim", "t", "sig", F.least("mine", "other").cast("int").alias("lo"), F.greatest("mine", "other").cast("int").alias("hi"), "mine", "rep", "own")

    def signs_of(g: pa.Table) -> np.ndarray:
        raw = np.frombuffer(text_bytes(g.column("own").combine_chunks())[0].tobytes(), np.uint8).reshape(g.num_rows, -1)
        return np.unpackbits(raw, axis=1, count=bits * tables)

    def first_here(signs: np.ndarray, t: int, pairs: np.ndarray) -> np.ndarray:
        """``pairs`` without those that agree in a table before the t-th."""
        sigs = signs.reshape(len(signs), tables, bits) @ powers
        for s in range(t):
            if not pairs.any():
                break
            pairs &= sigs[:, s][:, None] != sigs[:, s][None, :]
        return pairs

    def apart(g: pa.Table, pairs: np.ndarray) -> np.ndarray:
        """``pairs`` without those inside one of two different blocks, and without the diagonal."""
        if g.column("lo")[0].as_py() != g.column("hi")[0].as_py():
            own = g.column("mine").to_numpy()
            pairs &= own[:, None] != own[None, :]
        np.fill_diagonal(pairs, False)
        return pairs

    def near(batches):
        for g in groups(batches, 5):
            if g.num_rows < 2:
                continue
            signs = signs_of(g)
            x = signs.astype(np.float32) * 2 - 1
            pairs = apart(g, x @ x.T >= bits * tables - 2 * limit)
            some = np.flatnonzero(pairs.any(1))
            if len(some):
                pairs = first_here(signs[some], g.column("t")[0].as_py(), pairs[np.ix_(some, some)])
                yield from g.take(pa.array(some[pairs.any(1)])).combine_chunks().to_batches()

    staying = scratch.save(_keyed(dealt, keys).mapInArrow(near, dealt.schema), "staying")

    def compare(batches):
        for g in groups(batches, 5):
            if g.num_rows < 2:
                continue
            x, rep, mult = matrix(g.column("vec").combine_chunks()), g.column("rep").to_numpy(), g.column("mult").to_numpy()
            x = x / np.abs(x).max(1, keepdims=True)
            norm = np.sqrt((x * x).sum(1))
            linked = apart(g, (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold)
            some = np.flatnonzero(linked.any(1))
            if not len(some):
                continue
            linked, rep, mult = linked[np.ix_(some, some)], rep[some], mult[some]
            first = first_here(signs_of(g)[some], g.column("t")[0].as_py(), linked.copy())
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(first @ mult), pa.array(least_labels(linked, rep))], names=["rep", "n", "least"])

    met = staying.join(classes.select("rep", "vec", "mult"), "rep").select(*keys, "mine", "rep", "own", "vec", "mult")
    found = scratch.save(_keyed(met, keys).mapInArrow(compare, "rep long, n long, least long"), "found")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(scratch, found, "rep", "least")
    per_class = classes.select("key", "vec", "rep", "mult").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("key", "vec", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.join(per_class, ["key", "vec"]).select("id", "n_links", "component_id")
    alone = base.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    scratch.drop(signed, staying)
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

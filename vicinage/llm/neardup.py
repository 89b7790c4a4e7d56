"""Near-duplicate documents by min-max hashing of word shingles, exact confirmation, and connected components.

Each document's set of word shingles (as 64-bit hashes) is reduced to the minimum and the maximum of every
permutation, so a signature of 2k values takes k hash evaluations a shingle. Bands of four values make buckets.
Documents with equal sets are one class from the start. Buckets whose least member is the same are one group, so a
full set travels once for each group a class is in, not for each bucket: two that share a bucket meet in its group.
Groups are confirmed on the full sets as products of 0/1 matrices: a task returns to each document the least document
it reaches inside the group, never a list of pairs.

A group of more than ``block`` classes is first cut into blocks that each also get a few pivots of the group. Near
copies link to some pivot, and only blocks of classes that are still in different components afterwards are compared
with each other. Nothing is capped: every pair that shares a bucket is confirmed or already connected.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import U64, Scratch, hash_slices, mix, spans_of, text_bytes, words_of
from vicinage.llm.graph import connected_components, groups, least_labels

ROWS = 4
CHUNK = 1 << 20


def shingles(a: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts one after another, offsets of each text's); shorter texts are one shingle."""
    lower, starts, ends, words = words_of(a, offsets)
    h = hash_slices(lower, starts, ends)
    at = np.concatenate([[0], np.cumsum(words)])
    counts = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    if not len(h):
        return h, np.concatenate([[0], np.cumsum(counts)])
    full = np.zeros(len(h), np.uint64)
    for k in range(width):
        full[: len(h) - k] = full[: len(h) - k] * U64(0x9FB21C651E98DF25) + mix(h[k:] + U64(k + 1)) if k else mix(h + U64(1))
    short = np.flatnonzero((words > 0) & (words < width))
    for d in short.tolist():  # the whole sequence is one shingle
        v = 0
        for x in h[at[d] : at[d + 1]].tolist():
            v = (v * 0x9FB21C651E98DF25 + x + 0x51ED27) % (1 << 64)
        full[at[d]] = v
    position = np.arange(len(h)) - np.repeat(at[:-1], words)
    return mix(full)[position < np.repeat(counts, words)], np.concatenate([[0], np.cumsum(counts)])


def permutations(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def min_max(sets: np.ndarray, starts: np.ndarray, bands: int) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty sets laid end to end: minima and maxima of bands * 2 permutations."""
    mul, add = permutations(bands * ROWS // 2)
    values = np.empty((bands * ROWS, len(starts)), np.uint64)
    for k in range(len(mul)):
        z = sets * mul[k] + add[k]
        values[k] = np.minimum.reduceat(z, starts)
        values[len(mul) + k] = np.maximum.reduceat(z, starts)
    out = np.zeros((len(starts), bands), np.uint64)
    for r in range(ROWS):
        out = out * U64(0x9FB21C651E98DF25) + mix(values[r::ROWS].T + U64(r))
    return mix(mix(out) + np.arange(bands, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)).view(np.int64)  # a band's hashes are its own


def set_digests(sets: list[np.ndarray]) -> list[bytes | None]:
    return [hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets]


def signatures(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """id, n_shingles, key (16 bytes of the set's digest, null if empty), bands (array)."""

    def run(batches):
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in spans_of(offsets, CHUNK):
                flat, at = shingles(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                sets = [np.unique(flat[at[k] : at[k + 1]]) for k in range(j - i)]
                sizes = np.fromiter(map(len, sets), np.int64, j - i)
                some = sizes > 0
                keys = set_digests(sets)
                found = min_max(np.concatenate(sets), (np.cumsum(sizes) - sizes)[some], bands) if some.any() else np.zeros((0, bands), np.int64)
                ends = np.concatenate([[0], np.cumsum(some * bands)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel()))], names=["id", "n_shingles", "key", "bands"])

    return docs.mapInArrow(run, "id long, n_shingles long, key binary, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """docs: id, text -> id, rep (hash of the set's digest), size, set (sorted 64-bit shingle hashes as binary)."""

    def run(batches):
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in spans_of(offsets, CHUNK):
                flat, at = shingles(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                sets = [np.unique(flat[at[k] : at[k + 1]]) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(set_digests(sets), pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "key", "size", "set"])

    return docs.mapInArrow(run, "id long, key binary, size long, set binary").select("id", F.xxhash64("key").alias("rep"), "size", "set")


def set_keys(text, width: int):
    """The key of ``signatures`` as a column."""

    @F.arrow_udf("binary")
    def keys(texts: pa.Array) -> pa.Array:
        a, offsets = text_bytes(texts)
        out = []
        for i, j in spans_of(offsets, CHUNK):
            flat, at = shingles(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            out += set_digests([np.unique(flat[at[k] : at[k + 1]]) for k in range(j - i)])
        return pa.array(out, pa.binary())

    return keys(text)


def linked_sets(flat: np.ndarray, sizes: np.ndarray, percent: int, columns: int = 4096) -> np.ndarray:
    """Which of the sets (laid end to end) have 100 * intersection >= percent * union."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    if n <= 3:
        sets = [flat[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        both = np.zeros((n, n), np.float32)
        for i in range(n):
            for j in range(i):
                if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        value, owner = flat[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        col = np.cumsum(new) - 1
        shared = np.bincount(col)[col] > 1  # what one set alone holds is in no intersection
        col, owner = col[shared], owner[shared]
        if len(col):
            col = np.cumsum(np.concatenate([[False], col[1:] != col[:-1]]))
        both = np.zeros((n, n), np.float32)
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
            i, j = np.searchsorted(col, [lo, lo + columns])
            x = np.zeros((n, min(columns, int(col[-1]) + 1 - lo)), np.float32)
            x[owner[i:j], col[i:j] - lo] = 1
            both += x @ x.T
    out = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def confirm(rows: DataFrame, percent: int) -> DataFrame:
    """rows: keys g1, g2, g3, then rep, size, set -> edges (rep, least) of the confirmed links in each group."""

    def run(batches):
        for g in groups(batches, 3):
            rep, at = np.unique(g.column("rep").to_numpy(), return_index=True)
            if len(rep) < 2:
                continue
            sets = g.column("set").combine_chunks()
            linked = linked_sets(np.concatenate([np.frombuffer(sets[k].as_buffer(), np.uint64) for k in at.tolist()]), g.column("size").to_numpy()[at], percent)
            least = least_labels(linked, rep)
            some = least != rep
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(least[some])], names=["rep", "least"])

    keys = ["g1", "g2", "g3"]
    return rows.select(*keys, "rep", "size", "set").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, least long")


def components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 20, block: int = 1024, pivots: int = 32, small_ids: int = 2_000_000) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable), kept (it is the least itself).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct ``width``-word shingles, or the
    whole sequence of a shorter text. A null, empty or blank text has an empty set and links with nothing; so has a
    null id, whose component is null and which is kept. Rows of equal sets are one class; rows that repeat an id with
    another text are of a class, and maybe of a component, of their own. Each row is given. Ids are whole numbers; other
    columns are not read. Candidate ids, and the groups they are in, are broadcast only up to ``small_ids`` rows of them
    (16 MB, 64 MB); beyond it texts are joined by id and sets by class.
    """
    found = labelled(spark, docs, id_col, text_col, width, percent, bands, block, pivots, small_ids)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def labelled(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80, bands: int = 20, block: int = 1024, pivots: int = 32, small_ids: int = 2_000_000) -> DataFrame:
    """``components`` with the key of each row's set and a label of its component: id, n_shingles, key, component, component_id.

    A class goes by a 64-bit hash of its set's digest, since an id may lead several; the least ids come in at the end.
    """
    scratch = Scratch(spark, "minmax")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.save(signatures(src, width, bands), "signatures")
    usable = signed.where("id is not null and key is not null")
    # rows of one key have one set, so their bands are the same
    classes = scratch.save(usable.groupBy("key").agg(F.min("id").alias("least_id"), F.first("bands").alias("bands")).withColumn("rep", F.xxhash64("key")), "classes")
    spread = classes.select("rep", F.explode("bands").alias("hash"))
    buckets = spread.groupBy("hash").agg(F.count("*").alias("n"), F.min("rep").alias("lead")).where("n > 1").select("hash", "lead")
    members = scratch.save(spread.join(scratch.save(buckets, "buckets"), "hash").select("lead", "rep").distinct(), "members")
    members = scratch.save(without_subsets(members), "groups")
    wanted = scratch.save(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("least_id").alias("id")), "wanted")
    # an id that one row has leads one class with it; the sets of ids that repeat are told apart by their class
    again = scratch.save(usable.groupBy("id").count().where("count > 1").select("id"), "again")
    alone, several = wanted.join(again, "id", "left_anti").select("id"), wanted.join(again, "id", "left_semi")
    few = lambda x, n: F.broadcast(x) if n <= small_ids else x
    ids = wanted.count()
    sets = full_sets(src.join(few(alone, ids), "id", "left_semi").select("id", "text"), width).select("rep", "size", "set")
    if not again.isEmpty():
        own = full_sets(src.join(few(several.select("id").distinct(), ids), "id", "left_semi").select("id", "text"), width)
        sets = sets.unionByName(own.join(several, ["id", "rep"], "left_semi").dropDuplicates(["rep"]).select("rep", "size", "set"))
    sets = scratch.save(sets, "sets")
    sized = members.join(sets.select("rep", "size"), "rep")
    parts_of = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("s") / (block * 4096))).cast("int")
    hot = scratch.save(sized.groupBy("lead").agg(F.count("*").alias("n"), F.sum("size").alias("s")).withColumn("parts", parts_of).where("parts > 1").select("lead", "n", "parts"), "hot")
    any_hot = not hot.isEmpty()
    dealt = members
    if any_hot:
        large = members.join(hot, "lead")
        dealt = members.join(hot.select("lead", "parts"), "lead", "left").withColumn("own", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))))
        pivot = large.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.ceil(F.col("n") / pivots)) == 0).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("lead", "rep", F.col("own").cast("long")).unionByName(pivot.select("lead", "rep", F.col("own").cast("long"))).distinct()
    else:
        dealt = dealt.withColumn("own", F.lit(0).cast("long"))
    keyed = scratch.save(dealt.select(F.col("lead").alias("g1"), F.lit(0).cast("long").alias("g2"), F.col("own").alias("g3"), "rep"), "keyed")
    edges = scratch.save(confirm(sets.join(few(keyed, keyed.count()), "rep"), percent), "edges")
    parts = connected_components(scratch, edges, "rep", "least")
    if any_hot:
        rest = leftovers(scratch, large, parts, block)
        more = scratch.save(confirm(rest.join(sets, "rep"), percent), "more")
        if not more.isEmpty():
            known = parts.where("id <> component").select(F.col("id").alias("rep"), F.col("component").alias("least"))
            parts = connected_components(scratch, known.unionByName(more), "rep", "least")
        scratch.drop(more)
    scratch.drop(members, keyed, sets, hot, edges)
    linked = scratch.save(classes.select("rep", "least_id").join(parts.withColumnRenamed("id", "rep"), "rep"), "linked")
    least = scratch.save(linked.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    grouped = classes.join(linked.join(least, "component").select("rep", "component", "component_id"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"), F.coalesce("component_id", "least_id").alias("component_id"))
    known = usable.select("id", "n_shingles", "key").join(grouped, "key").select("id", "n_shingles", "key", "component", "component_id")
    alone = signed.where("id is null or key is null").select("id", "n_shingles", "key", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return known.unionByName(alone)


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small_ids: int = 2_000_000, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a near-duplicate of smaller id.

    Of rows that repeat an id with equal or linked sets the one with the longest text stays (then the greatest row);
    rows of null id all stay. Only ids to drop or repeated ones are joined to the texts: by broadcast up to
    ``small_ids`` of them, else by a shuffle.
    """
    scratch = Scratch(spark, "oneofeach")
    found = scratch.save(labelled(spark, docs, id_col, text_col, small_ids=small_ids, **options).where("id is not null").select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("component").alias("_component"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "kept")
    per = found.groupBy("_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    drop, again = (scratch.save(x.select("_id"), n) for x, n in ((per.where("not kept"), "drop"), (per.where("kept and n > 1"), "again")))
    few = lambda x: F.broadcast(x) if x.count() <= small_ids else x
    key = F.col(id_col).cast("long") == F.col("_id")
    left = docs.join(few(drop), key, "left_anti")
    if again.isEmpty():
        return left
    row = F.struct(F.length(F.coalesce(text_col, F.lit(""))).alias("_n"), *(F.col(f"`{c}`") for c in docs.columns))
    once = left.join(few(again), key, "left_semi").select(F.col(id_col).cast("long").alias("_id"), set_keys(F.col(text_col), options.get("width", 5)).alias("_key"), row.alias("_r"))
    once = once.groupBy("_id", "_key").agg(F.max("_r").alias("_r")).alias("o")
    sets = found.join(few(again), "_id", "left_semi").where("kept").select("_id", "_key", "_component").distinct().alias("s")
    once = once.join(sets, (F.col("o._id") == F.col("s._id")) & F.col("o._key").eqNullSafe(F.col("s._key")))
    once = once.groupBy("o._id", "_component").agg(F.max("_r").alias("_r")).select(*(F.col(f"_r.`{c}`").alias(c) for c in docs.columns))
    return left.join(few(again), key, "left_anti").unionByName(once)


def without_subsets(members: DataFrame) -> DataFrame:
    """members (lead, rep) without the groups that lie wholly in the group of the least lead their own lead is in.

    Near copies that miss the least one in some band make a smaller group in it; every pair of such a group meets in
    the larger one. Leads only get less on the way up, so the last group of a chain stays.
    """
    above = members.where("lead <> rep").groupBy(F.col("rep").alias("lead")).agg(F.min("lead").alias("above"))
    inner = members.join(above, "lead")
    outer = members.select(F.col("lead").alias("above"), "rep", F.lit(1).alias("there"))
    held = inner.join(outer, ["above", "rep"], "left").groupBy("lead").agg(F.count("*").alias("n"), F.count("there").alias("there"))
    return members.join(held.where("n = there").select("lead"), "lead", "left_anti")


def leftovers(scratch: Scratch, large: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """Members of large groups dealt to pairs of blocks that may still hold unlinked pairs: g1, g2, g3, rep.

    Inside a group, a component of at least ``block`` members gets blocks of its own, all smaller ones share mixed
    blocks. Two blocks of one and the same component need no comparison. The sizes are tables, so that a component
    of many members is only a skewed join, which is split.
    """
    member = large.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("lead", "rep", F.coalesce("component", "rep").alias("c"))
    per = scratch.save(member.groupBy("lead", "c").count(), "per")
    big = per.where(F.col("count") >= block).select("lead", "c", F.ceil(F.col("count") / block).cast("int").alias("k"))
    small = scratch.save(per.where(F.col("count") < block).groupBy("lead").agg(F.ceil(F.sum("count") / block).cast("int").alias("mixed")), "mixed")
    placed = member.join(big, ["lead", "c"], "left").join(small, "lead", "left")
    pure = F.col("k").isNotNull()
    placed = placed.select("lead", "rep", F.when(pure, F.col("c")).otherwise(F.lit(-1)).alias("c"), F.pmod(F.xxhash64("rep"), F.when(pure, F.col("k")).otherwise(F.col("mixed"))).alias("p"))
    blocks = placed.select("lead", "c", "p").distinct()
    a, b = blocks.alias("a"), blocks.alias("b")
    before = (F.col("a.c") < F.col("b.c")) | ((F.col("a.c") == F.col("b.c")) & (F.col("a.p") <= F.col("b.p")))
    pairs = a.join(b, (F.col("a.lead") == F.col("b.lead")) & before & ((F.col("a.c") != F.col("b.c")) | (F.col("a.c") == -1)))
    pairs = pairs.select("a.lead", F.xxhash64("a.c", "a.p").alias("g2"), F.xxhash64("b.c", "b.p").alias("g3"), F.explode(F.array(F.struct("a.c", "a.p"), F.struct("b.c", "b.p"))).alias("s")).select("lead", "g2", "g3", "s.c", "s.p").distinct()
    return placed.join(pairs, ["lead", "c", "p"]).select(F.col("lead").alias("g1"), "g2", "g3", "rep")


def miss_rate(similarity: float, bands: int) -> float:
    """Probability that a pair of that similarity shares no band."""
    return math.pow(1 - similarity**ROWS, bands)

"""Hierarchical residual packing of documents into fixed-length training sequences.

Every partition tokenizes its documents, cuts what is too long, and numbers its pieces of each length. A leaf of the
tree, a partition as a rule, packs its pieces best fit; bins that are nearly full leave as sequences, the underfull
ones go up as items: as one item if little room is left, else opened, so that two halves of a bin that fit badly can
part again. A node merges the items of its children by a further best-fit round, emits what is nearly full and passes
the rest on; the root emits everything.

Lengths and fills are integers up to ``size``, so the items of a node are known by a count per fill, whatever their
number: a round is planned on at most ``size`` counts, and its plan is a short list of runs of equal slots. The number
of an item among those of its fill gives its slot, so placing the pieces is a join with the plans, level by level.
No node holds the items, none is left out or kept back, and texts and token ids are never shuffled.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import Scratch, spans_of, text_bytes
from vicinage.llm.pretoken import Pieces, encode_texts

PIECES = "piece int, start long, length long, ids_crc32 long, part int, number long"


class WordTokenizer:
    """A tokenizers file applied to each distinct pre-token once; texts that aren't plain are encoded whole."""

    kept: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces = Pieces(self.many)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for lo in range(0, len(pieces), 4096):  # the library's result objects are large
            got += [x.ids for x in self.t.encode_batch_fast([x.decode() for x in pieces[lo : lo + 4096]], add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.int32, int(lengths.sum())), lengths

    def whole(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def encode(self, a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return encode_texts(a, offsets, self.pieces, self.whole)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin) of best-fit decreasing; ``plan`` does the same on counts.

    Open bins are kept by their room; a bit set of the rooms in use finds the tightest one that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, fills = 0, []
    for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            open_ = by_room[room]
            b = open_.pop()
            if not open_:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), size
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += n
        if left := room - n:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, np.asarray(fills, np.int64)


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best-fit decreasing of items given as a count per length: (deals, bins).

    A deal (length, number, each, first, many, offset) gives the items of that length from the number on to the bins
    [first, first + many), ``each`` to a bin, the first at the offset. Bins come as (first, many, fill). Bins with the
    same room are kept as runs, so the work depends on the distinct lengths, not on the counts.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}
    rooms, made, deals, full = 0, 0, [], []
    for n, count in sorted(counts.items(), reverse=True):
        number = 0
        while number < count:
            fitting = rooms >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                runs = by_room[room]
                first, many = runs.pop()
                if not runs:
                    rooms &= ~(1 << room)
            else:
                room, first, many = size, made, -(-(count - number) // (size // n))
                made += many
            # the tightest bin stays the tightest until it is full, so it takes all it can
            each = min(room // n, count - number)
            used = min(many, (count - number) // each)
            deals.append((n, number, each, first, used, size - room))
            number += used * each
            for left, lo, k in ((room - each * n, first, used), (room, first + used, many - used)):
                if left and k:
                    by_room.setdefault(left, []).append((lo, k))
                    rooms |= 1 << left
                elif k:
                    full.append((lo, k, size))
    return deals, sorted(full + [(lo, k, size - room) for room, runs in by_room.items() for lo, k in runs])


def round_of(counts: dict[int, int], size: int, emit: int, whole: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], dict[int, int]]:
    """One best-fit round on items given as a count per fill: (runs, items for the next round as a count per fill).

    A run (fill, first, each, bins, made, bin fill, offset) deals the items of its fill from the number ``first`` on,
    ``each`` to a bin, into bins that are filled alike in the end. Bins filled to ``emit`` or more are finished, and
    numbered from ``made`` on among the round's finished ones. Others are items of the next round, numbered among
    those of their fill: as one item from a fill of ``whole`` on, below it opened, each of their items for itself.
    """
    deals, bins = plan(counts, size)
    starts, made, named = [b[0] for b in bins], {}, []
    for _, many, fill in bins:
        key = -1 if fill >= emit else fill
        named.append(made.get(key, 0))
        if fill >= min(emit, whole):
            made[key] = named[-1] + many
    out = []
    for n, number, each, first, many, offset in deals:
        at = bisect.bisect_right(starts, first) - 1
        while at < len(bins) and bins[at][0] < first + many:
            lo, hi, fill = max(first, bins[at][0]), min(first + many, bins[at][0] + bins[at][1]), bins[at][2]
            item = number + (lo - first) * each
            if fill >= min(emit, whole):
                out.append((n, item, each, hi - lo, named[at] + lo - bins[at][0], fill, offset))
            else:
                out.append((n, item, 1, each * (hi - lo), made.get(n, 0), n, 0))
                made[n] = made.get(n, 0) + each * (hi - lo)
            at += 1
    made.pop(-1, 0)
    return out, made


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first piece takes the remainder."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def tokenize(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, each with its partition and its number among the partition's pieces of its length."""

    def run(batches):
        t = WordTokenizer.of(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0)
            a, offsets = text_bytes(batch.column(1))
            for i, j in spans_of(offsets, 1 << 20):
                ids, at = t.encode(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held = []
                for k in range(j - i):
                    own = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4")
                    for p, (s, n) in enumerate(cut(len(own), size)):
                        held.append((i + k, p, s, n, zlib.crc32(own[s : s + n].tobytes())))
                if not held:
                    continue
                row, piece, start, length, crc = zip(*held, strict=True)
                lengths = np.asarray(length, np.int64)
                order = np.argsort(lengths, kind="stable")
                sizes = np.bincount(lengths, minlength=size + 1)
                numbers = np.empty(len(lengths), np.int64)
                numbers[order] = np.arange(len(lengths)) + (seen - (np.cumsum(sizes) - sizes))[lengths[order]]
                seen += sizes
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(len(lengths), part, np.int32)), pa.array(numbers)],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "number"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {PIECES}")


RUNS = "child int, fill int, first long, each long, bins long, made long, bin_fill int, offset int, node int, done boolean"


def plan_level(items: DataFrame, size: int, emit: int, whole: int) -> DataFrame:
    """A round for every node: items (node, child, fill, n) -> RUNS, with ``first`` counted within the child; rows
    without a child hold what the node passes on, a count per fill."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["fill", "child"])
        counts = t.groupby("fill")["n"].sum()
        runs: dict[int, list[tuple]] = {}
        dealt, left = round_of({int(k): int(v) for k, v in counts.items()}, size, emit, whole)
        for n, *run in dealt:
            runs.setdefault(n, []).append(run)
        node, before, last = int(t["node"].iat[0]), 0, -1
        out = [(None, fill, 0, 1, n, 0, fill, 0, node, False) for fill, n in left.items()]
        for child, fill, n in zip(t["child"].tolist(), t["fill"].tolist(), t["n"].tolist(), strict=True):
            before = 0 if fill != last else before
            own = runs[fill]
            if fill != last:
                starts, last = [r[0] for r in own], fill
            at = bisect.bisect_right(starts, before) - 1
            while at < len(own) and own[at][0] < before + n:
                first, each, bins, made, bin_fill, offset = own[at]
                out.append((child, fill, first - before, each, bins, made, bin_fill, offset, node, bin_fill >= emit))
                at += 1
            before += n
        return pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")]).astype({"child": "Int32"})

    return items.groupBy("node").applyInPandas(one, RUNS)


def climb(placed: DataFrame, runs: DataFrame, level: int) -> DataFrame:
    """Pieces moved from the bin they lie in to the bin of the next level, or to their sequence."""
    found = runs.where("child is not null").groupBy("child", "fill").agg(F.array_sort(F.collect_list(F.struct("first", "each", "made", "bin_fill", F.col("offset").alias("at"), "node", "done"))).alias("runs"))
    run = F.try_element_at(F.filter("runs", lambda r: r["first"] <= F.col("number")), F.lit(-1))
    moved = placed.join(found, ["child", "fill"], "left").withColumn("r", run).withColumn("d", F.col("number") - F.col("r.first"))
    kept = ("id", "piece", "start", "length", "ids_crc32")
    number = F.col("r.made") + F.floor(F.col("d") / F.col("r.each"))
    sequence = F.coalesce("sequence_id", F.when(F.col("r.done"), F.lit(level << 58) + F.shiftleft(F.col("r.node").cast("long"), 32) + number))
    offset = F.col("offset") + F.coalesce(F.col("r.at") + F.pmod("d", "r.each") * F.col("fill"), F.lit(0))
    goes_on = F.col("r").isNotNull() & ~F.col("r.done")
    return moved.select(*kept, sequence.alias("sequence_id"), offset.cast("int").alias("offset"), F.when(goes_on, F.col("r.node")).alias("child"), F.when(goes_on, F.col("r.bin_fill")).alias("fill"), F.when(goes_on, number).alias("number"))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, fan_in: int = 32, nearly: int = 4, leaf_pieces: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: id, piece, start, length, ids_crc32, sequence_id, offset.

    Bins with at most ``nearly`` free places leave the tree; fuller than 15/16 they go up whole, emptier ones opened. A leaf is the shortest stretch of neighbouring partitions
    that holds ``leaf_pieces`` pieces, since a best-fit round over fewer wastes room; ``fan_in`` nodes make one of the
    next level. A null or empty text is the end token alone; a null id is kept; repeated rows are packed one by one;
    no rows give no rows; other columns are not read.
    """
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(tokenize(docs, tokenizer_path, size, end_id, id_col, text_col), "pieces")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    leaves, held = [], 0
    for part, n in sorted((r[0], r[1]) for r in counts.groupBy("part").agg(F.sum("n")).collect()):  # one row a partition
        leaves.append((part, held // leaf_pieces))
        held += n
    names = {old: new for new, old in enumerate(sorted({leaf for _, leaf in leaves}))}
    where = spark.createDataFrame([(part, names[leaf]) for part, leaf in leaves], "child int, node int")
    # items of a node: a count per child and fill, and the number of each child's first one among the node's
    items = scratch.save(counts.join(where.withColumnRenamed("child", "part"), "part").select(F.col("node"), F.col("part").alias("child"), F.col("length").cast("int").alias("fill"), "n"), "items")
    width, level = len(names), 0
    placed = pieces.select("id", "piece", "start", "length", "ids_crc32", F.lit(None).cast("long").alias("sequence_id"), F.lit(0).alias("offset"), F.col("part").alias("child"), F.col("length").cast("int").alias("fill"), "number")
    while width:
        runs = scratch.save(plan_level(items, size, 0 if width == 1 else size - nearly, size - size // 16), f"plan{level}")
        placed = climb(placed, runs, level)
        if width == 1:
            break
        width, level = -(-width // fan_in), level + 1
        items = runs.where("child is null").select(F.floor(F.col("node") / fan_in).cast("int").alias("node"), F.col("node").alias("child"), "fill", F.col("bins").alias("n"))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))

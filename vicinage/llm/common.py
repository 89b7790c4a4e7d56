"""Helpers shared by the training-data operators: shared-folder tables, Arrow buffers, hashing.

Nothing here keeps a file on a machine-local disk of a cluster: intermediate tables go to the folder named by
``spark.checkpoint.dir``; on a cluster that names none the operators stop with an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; an error if a cluster names none, for another machine's disk can't be read.

    A local session has one machine only: it gets a temporary folder, made once and removed at the end.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="vicinage-", ignore_cleanup_errors=True))
    return f"file://{_LOCAL[0].name}"


_LOCAL: list[tempfile.TemporaryDirectory] = []


@contextmanager
def text_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows while a table of whole texts is worked off; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Intermediate tables of one query, written as Parquet under the shared folder.

    Writing a table cuts the lineage: a lost executor costs the tasks it ran, never a whole chain of rounds. Tables
    that no later plan reads are dropped at once, the others when the session's file system closes.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/vicinage-{tag}-{uuid.uuid4().hex}", 0
        self._files(self.root).deleteOnExit(self._path(self.root))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        with text_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vicinage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later plan reads."""
        for df in tables:
            self._files(df._vicinage_path).delete(self._path(df._vicinage_path), True)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column without copying; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes add up to about ``most``; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain murmur constants), in place on a fresh array."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_STEP = U64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def words_at(a: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of ``a`` on as one number; behind the end there are zeros."""
    padded = np.zeros(len(a) + 16, np.uint8)
    padded[: len(a)] = a
    return np.ndarray((len(a) + 8,), "<u8", padded, 0, (1,))


def tail_words(size: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The eight-byte words behind the first one of slices of the given sizes: (slice, word number, bytes in it)."""
    more = np.maximum(size - 1, 0) >> 3
    ends = np.cumsum(more)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        w = np.arange(lo, min(lo + most, int(ends[-1])))
        own = np.searchsorted(ends, w, "right")
        k = w - (ends[own] - more[own]) + 1
        yield own, k, np.minimum(size[own] - 8 * k, 8)


def hash_slices(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices [starts, ends) of ``a``, vectorised.

    Every eight-byte word is mixed by itself, then with its place in the slice, before the words are added up, so no
    pattern of repeated words cancels out as it would in a polynomial. Long slices are worked off in stretches.
    """
    view, size = words_at(a), ends - starts
    total = mix((view[starts] & _MASK[np.minimum(size, 8)]) + _STEP)
    long = np.flatnonzero(size > 8)
    begin = starts[long]
    for own, k, left in tail_words(size[long]):
        v = mix(mix((view[begin[own] + 8 * k] & _MASK[left]) + _STEP) ^ (k.astype(np.uint64) * _STEP))
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[long[own[heads]]] += np.add.reduceat(v, heads)
    return mix(total ^ (size.astype(np.uint64) * U64(0xD6E8FEB86659FD93)))


def same_slices(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, b: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which byte slices [starts, ends) of ``a`` equal the slices [others, other_ends) of ``b``, byte by byte."""
    va, vb, size = words_at(a), words_at(b), ends - starts
    same = size == other_ends - others
    first = _MASK[np.minimum(size, 8)]
    same &= (va[starts] & first) == (vb[others] & first)
    long = np.flatnonzero(same & (size > 8))
    s, o = starts[long], others[long]
    for own, k, left in tail_words(size[long]):
        bad = ((va[s[own] + 8 * k] ^ vb[o[own] + 8 * k]) & _MASK[left]) != 0
        same[long[own[bad]]] = False
    return same


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts laid end to end, A-Z lower-cased.

    Returns (lower-cased bytes, starts, ends, words per text). Bytes of UTF-8 sequences never look like white space.
    """
    a = _LOWER[a]
    inside = np.empty(len(a) + 1, np.int8)
    inside[:-1] = ~_SPACE[a]
    inside[-1] = 0
    first = inside[:-1].astype(bool)
    first[1:] &= ~inside[:-2].astype(bool)
    heads = offsets[:-1][offsets[:-1] < len(a)]
    first[heads] = inside[heads]
    last = inside[:-1].astype(bool) & ~inside[1:].astype(bool)
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return a, starts, ends, counts


def repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [starts, starts + lengths) one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def bucket_of_doc(col: str = "doc_id"):
    """crc32 of the id's decimal text modulo 5, as a column; 0 marks a held-out row. A null id is held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(5), F.lit(0))

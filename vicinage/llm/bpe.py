"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

For each pre-token a segment tree over its byte positions holds, at every inner node, the smallest
``rank * 2**32 + position`` of the pairs below it, so the root names the leftmost pair of minimum rank. A merge
writes three leaves (the merged pair, its live left neighbour, and the dead right part) and refreshes their paths:
O(log n) a merge. Many short pre-tokens are worked off together, one row of a matrix each; long ones one by one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vicinage.llm.common import repeat_ranges, spans_of, text_bytes
from vicinage.llm.pretoken import Pieces, encode_texts

INF = np.int64(1) << np.int64(62)
#: Unicode White_Space, which is what ``\s`` means to the library whose splits are matched.
WHITE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, (0x1680, 0x2000))) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class Ranks:
    """A rank file as arrays: token bytes, and the merged token of every pair of tokens that has one."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.by_bytes = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        top = max(self.by_bytes.values()) + 1
        self.token = [b""] * top
        for x, y in self.by_bytes.items():
            self.token[y] = x
        self.byte = np.array([self.by_bytes[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for x, y in self.by_bytes.items():
            for k in range(1, len(x)):
                left, right = self.by_bytes.get(x[:k]), self.by_bytes.get(x[k:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = y
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        lengths = np.fromiter(map(len, self.token), np.int64, top)
        self.token_len, self.token_at = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token of each pair, which is also its rank; -1 if the pair never merges."""
        if not len(self.keys):
            return np.full(left.shape, -1, np.int64)
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids)
        return self.token_bytes[repeat_ranges(self.token_at[ids], self.token_len[ids])].tobytes()


def encode_long(ranks: Ranks, piece: bytes) -> list[int]:
    """One pre-token by a segment tree in plain lists; for pre-tokens of any length."""
    n = len(piece)
    token = [int(ranks.byte[b]) for b in piece]
    size = 1
    while size < n:
        size *= 2
    inf = int(INF)
    tree = [inf] * (2 * size)
    pairs = ranks.pairs
    for i in range(n - 1):
        r = pairs.get((token[i] << 32) | token[i + 1])
        if r is not None:
            tree[size + i] = (r << 32) | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            value = tree[2 * i] if tree[2 * i] <= tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == value:
                return
            tree[i] = value
            i >>= 1

    def pair(i: int) -> int:
        j = after[i]
        r = pairs.get((token[i] << 32) | token[j]) if j < n else None
        return inf if r is None else (r << 32) | i

    while tree[1] < inf:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        token[i] = tree[1] >> 32
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        put(j, inf)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return out


def encode_rows(ranks: Ranks, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, ids of each) of pre-tokens of at most ``size`` bytes, by segment trees side by side."""
    m = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(m, size)
    token = ranks.byte[raw]
    cols = np.arange(size, dtype=np.int64)
    after, before = np.tile(cols + 1, (m, 1)), np.tile(cols - 1, (m, 1))
    tree = np.full((m, 2 * size), INF, np.int64)
    if size > 1:
        r = ranks.rank(token[:, :-1], token[:, 1:])
        ok = (r >= 0) & (cols[None, 1:] < lengths[:, None])
        tree[:, size : 2 * size - 1] = np.where(ok, (r << 32) | cols[None, :-1], INF)
    half = size // 2
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half //= 2
    live = np.ones((m, size), bool)
    live &= cols[None] < lengths[:, None]

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        i = at + size
        tree[rows, i] = value
        i >>= 1
        while i[0]:
            tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])
            i >>= 1

    def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = after[rows, at]
        r = np.where(nxt < lengths[rows], ranks.rank(token[rows, at], token[rows, np.minimum(nxt, size - 1)]), -1)
        return np.where(r >= 0, (r << 32) | at, INF)

    rows = np.flatnonzero(tree[:, 1] < INF)
    while len(rows):
        top = tree[rows, 1]
        i = top & 0xFFFFFFFF
        j = after[rows, i]
        token[rows, i] = top >> 32
        after[rows, i] = k = after[rows, j]
        live[rows, j] = False
        inside = k < lengths[rows]
        before[rows[inside], k[inside]] = i[inside]
        put(rows, j, np.full(len(rows), INF, np.int64))
        put(rows, i, pair(rows, i))
        b = before[rows, i]
        has = b >= 0
        if has.any():
            put(rows[has], b[has], pair(rows[has], b[has]))
        rows = rows[tree[rows, 1] < INF]
    return token[live].astype(np.int32), live.sum(1)


def encode_pieces(ranks: Ranks, pieces: list[bytes], widest: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, ids of each) of pre-tokens of any lengths."""
    m = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, m)
    bits = np.zeros(m, np.int64)
    for k in range(int(lengths.max(initial=1) - 1).bit_length()):
        bits += lengths > (1 << k)
    flats, owners, counts = [], [], np.zeros(m, np.int64)
    for bit in np.unique(bits):
        ks = np.flatnonzero(bits == bit)
        size = 1 << int(bit)
        step = max(1, (1 << 17) // size) if size <= widest else 1
        for lo in range(0, len(ks), step):
            part = ks[lo : lo + step]
            if size <= widest:
                flat, counts[part] = encode_rows(ranks, [pieces[k] for k in part.tolist()], size)
            else:
                flat = np.asarray(encode_long(ranks, pieces[part[0]]), np.int32)
                counts[part] = len(flat)
            flats.append(flat)
            owners.append(part)
    order = np.concatenate(owners)
    at = np.empty(m, np.int64)
    at[order] = np.cumsum(counts[order]) - counts[order]
    return np.concatenate(flats)[repeat_ranges(at, counts)], counts


class Codec:
    """Encoder and decoder for one rank file and pattern; one is kept per worker."""

    kept: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.pattern = regex.compile(pattern.replace(r"[^\s\p", rf"[^{WHITE}\p").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.pieces = Pieces(lambda xs: encode_pieces(self.ranks, xs))
        numbers = [b"%d," % i for i in range(len(self.ranks.token))]
        lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
        self.number_len, self.number_at = lengths, np.cumsum(lengths) - lengths
        self.number_bytes = np.frombuffer(b"".join(numbers), np.uint8)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls.kept:
            cls.kept[path, pattern] = cls(path, pattern)
        return cls.kept[path, pattern]

    def whole(self, text: str) -> list[int]:
        parts = [x.encode() for x in self.pattern.findall(text)]
        if not parts:
            return []
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths)
        return self.pieces.ids(np.frombuffer(b"".join(parts), np.uint8), ends - lengths, ends)[0]

    def encode(self, a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return encode_texts(a, offsets, self.pieces, self.whole)

    def numbers(self, ids: np.ndarray) -> bytes:
        return self.number_bytes[repeat_ranges(self.number_at[ids], self.number_len[ids])].tobytes()[:-1]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 20) -> DataFrame:
    """Encode every text and decode the ids again: id, token_ids (array), decoded (binary).

    A null or empty text has no ids and decodes to nothing; a null id is passed through; repeated rows give
    repeated results; columns other than the two named are not read, so clashing names can't occur.
    """

    def run(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in spans_of(offsets, chunk_bytes):
                ids, at = codec.encode(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = [ids[at[k] : at[k + 1]] for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array([codec.ranks.decode(x) for x in rows], pa.binary())], names=["id", "token_ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, token_ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 20) -> DataFrame:
    """As encode_documents, with the ids and decoded bytes reduced to their count and SHA-256 in the worker."""

    def run(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in spans_of(offsets, chunk_bytes):
                ids, at = codec.encode(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = [ids[at[k] : at[k + 1]] for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64())] + [pa.array([hashlib.sha256(f(x)).hexdigest() for x in rows], pa.string()) for f in (codec.numbers, codec.ranks.decode)],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

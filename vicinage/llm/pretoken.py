"""Splitting texts into pre-tokens by the public byte-level pattern, on whole Arrow batches.

Texts made of ASCII (without apostrophes and control characters) and two-byte Latin letters are split by
vectorised class changes, which gives the same pieces as the pattern; any other text takes the pattern itself.
Each distinct piece is encoded once per worker and looked up afterwards, so a tokenizer sees each word once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vicinage.llm.common import hash_slices, repeat_ranges, same_slices

LETTER, DIGIT, MARK, SPACE, BREAK, OTHER = 1, 2, 3, 4, 5, 0
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[33:127] = MARK
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[32] = SPACE
_CLASS[9:14] = BREAK
_CLASS[39] = OTHER  # an apostrophe may begin a contraction
_CLASS[0xC3] = LETTER
_CLASS[0x80:0xC0] = LETTER  # only after 0xC3; checked below


def plain_rows(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the vectorised split is exact for."""
    bad = _CLASS[a] == OTHER
    high = a >= 0x80
    if high.any():
        lead = a == 0xC3
        after = np.zeros(len(a), bool)
        after[1:] = lead[:-1]
        bad |= high & ~lead & ~after  # a continuation byte of another lead byte
        bad |= after & ((a == 0x97) | (a == 0xB7))  # the multiplication and division signs
    seen = np.concatenate([[0], np.cumsum(bad)])
    return seen[offsets[1:]] == seen[offsets[:-1]]


def split_plain(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens of plain texts laid end to end."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    c = _CLASS[a]
    ws = c >= SPACE
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    prev_ws = np.empty(n, bool)
    prev_ws[0] = False
    prev_ws[1:] = ws[:-1]
    next_ws = np.empty(n, bool)
    next_ws[-1] = True
    next_ws[:-1] = ws[1:]
    next_ws |= edge[1:]  # nothing follows the last character of a text
    changed = np.empty(n, bool)
    changed[0] = True
    changed[1:] = c[1:] != c[:-1]
    after_space = np.zeros(n, bool)
    after_space[1:] = c[:-1] == SPACE
    start = np.where(ws, ~prev_ws | ~next_ws, changed & ~after_space)
    start[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(start)


class Pieces:
    """Ids of every distinct piece seen by this worker; forgotten beyond ``most`` pieces.

    Pieces are found by a 64-bit hash and told apart by their bytes: one whose hash belongs to another piece is
    encoded by itself each time.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)  # ids of a slot in ``flat``
        self.from_, self.to = np.zeros(0, np.int32), np.zeros(0, np.int32)  # bytes of a slot in ``raw``
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.raw, self.filled = np.zeros(1 << 17, np.uint8), 0

    def add(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode slices of ``a`` into new slots."""
        text, size = a.tobytes(), ends - starts
        flat, lengths = self.encode([text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        for name, at, new in (("flat", self.used, flat), ("raw", self.filled, a[repeat_ranges(starts, size)])):
            held = getattr(self, name)
            if at + len(new) > len(held):
                held = np.concatenate([held, np.zeros(max(len(held), len(new)), held.dtype)])
                setattr(self, name, held)
            held[at : at + len(new)] = new
        slots = len(self.start) + np.arange(len(starts))
        ids_end, bytes_end = self.used + np.cumsum(lengths), self.filled + np.cumsum(size)
        self.start, self.length = np.concatenate([self.start, (ids_end - lengths).astype(np.int32)]), np.concatenate([self.length, lengths.astype(np.int32)])
        self.from_, self.to = np.concatenate([self.from_, (bytes_end - size).astype(np.int32)]), np.concatenate([self.to, bytes_end.astype(np.int32)])
        self.used, self.filled = int(ids_end[-1]), int(bytes_end[-1])
        return slots

    def ids(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, ids per piece)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        unique, at, inverse = np.unique(hash_slices(a, starts, ends), return_index=True, return_inverse=True)
        if len(self.start) > self.most or self.filled > 1 << 30:
            self.clear()
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        slot = np.empty(len(unique), np.int64)
        slot[known] = self.slots[place[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            slot[new] = self.add(a, starts[at[new]], ends[at[new]])
            self.keys, self.slots = np.insert(self.keys, place[new], unique[new]), np.insert(self.slots, place[new], slot[new])
        slot = slot[inverse]
        odd = np.flatnonzero(~same_slices(a, starts, ends, self.raw[: self.filled], self.from_[slot].astype(np.int64), self.to[slot].astype(np.int64)))
        if len(odd):
            slot[odd] = self.add(a, starts[odd], ends[odd])
        counts = self.length[slot].astype(np.int64)
        return self.flat[repeat_ranges(self.start[slot].astype(np.int64), counts)], counts


def encode_texts(a: np.ndarray, offsets: np.ndarray, pieces: Pieces, whole: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, offsets of each text's ids); ``whole`` encodes the texts that aren't plain."""
    rows = len(offsets) - 1
    plain = plain_rows(a, offsets)
    if plain.all():
        starts = split_plain(a, offsets)
        ids, counts = pieces.ids(a, starts, np.append(starts[1:], len(a)))
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(starts, offsets)]
    parts, lengths = [], np.zeros(rows, np.int64)
    i = 0
    while i < rows:
        j = i
        while j < rows and plain[j] == plain[i]:
            j += 1
        if plain[i]:
            got, at = encode_texts(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], pieces, whole)
            parts.append(got)
            lengths[i:j] = np.diff(at)
        else:
            for k in range(i, j):
                parts.append(np.asarray(whole(a[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")), np.int32))
                lengths[k] = len(parts[-1])
        i = j
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(lengths)])

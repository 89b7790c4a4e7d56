import base64
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from vicinage.llm import bpe, pretoken
from vicinage.llm.common import hash_slices, same_slices, spans_of, text_bytes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = "ab'stmlvred \n\t\r  é×÷ñß¼²世\U0001f600\x85\xa0\x1c 　0１9..!\"'"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)]
    return out + ["", " ", "\n\n", "  x", "a" * 5000, "ab" * 700 + " " * 700, "é" * 999, "it's we'll 's  's", "don't<|endoftext|>stop"]


def test_ids_equal_the_library(library):
    codec = bpe.Codec.of(PATH, public_tokenizers.PATTERN)
    given = texts()
    a, offsets = text_bytes(pa.array(given))
    for i, j in spans_of(offsets, 1 << 12):
        ids, at = codec.encode(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            own = ids[at[k] : at[k + 1]]
            assert own.tolist() == library.encode_ordinary(given[i + k])
            assert codec.ranks.decode(own).decode() == given[i + k]


def test_both_trees_agree():
    ranks = bpe.Ranks(PATH)
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aeinrst ") for _ in range(rng.randrange(1, 65))) for _ in range(400)]
    flat, counts = bpe.encode_rows(ranks, words, 64)
    rows = np.split(flat, np.cumsum(counts)[:-1])
    assert all(r.tolist() == bpe.encode_long(ranks, w) for r, w in zip(rows, words, strict=True))


def test_awkward_rows(spark, awkward, nothing, library):
    got = bpe.encode_documents(awkward, PATH, public_tokenizers.PATTERN).collect()
    given = awkward.collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in given]
    assert [list(r.token_ids) for r in got] == [library.encode_ordinary(r.text or "") for r in given]
    assert [bytes(r.decoded) for r in got] == [(r.text or "").encode() for r in given]
    assert bpe.encode_digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def twins(n):
    """The Thue-Morse word of n letters and its complement, which polynomial hashes confuse."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return [s, s.translate(str.maketrans("ab", "ba"))]


@pytest.mark.parametrize("poor", [False, True])
def test_pieces_are_told_apart_by_their_bytes(library, monkeypatch, poor):
    if poor:  # whatever the hash: nearly all pieces share one of three values
        monkeypatch.setattr(pretoken, "hash_slices", lambda a, s, e: (e - s).astype(np.uint64) % np.uint64(3))
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    for text in twins(1024) + twins(2048) + twins(4096) + [" ".join(texts()[:60])] * 2:
        a, offsets = text_bytes(pa.array([text]))
        assert codec.encode(a, offsets)[0].tolist() == library.encode_ordinary(text)


def test_equal_slices():
    rng = np.random.default_rng(0)
    a = rng.integers(97, 99, 20000).astype(np.uint8)
    ends = np.sort(rng.choice(20001, 3000, replace=False))
    starts = np.concatenate([[0], ends[:-1]])
    pieces = [a[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    got = same_slices(a, starts, ends, a, starts[::-1].copy(), ends[::-1].copy())
    assert got.tolist() == [x == y for x, y in zip(pieces, pieces[::-1], strict=True)]
    hashes = dict(zip(pieces, hash_slices(a, starts, ends).tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes) and [hashes[x] for x in pieces] == hash_slices(a, starts, ends).tolist()

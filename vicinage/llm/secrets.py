"""Secrets by fixed patterns and by dictionary-primed compression novelty.

A candidate is a long unbroken string that follows a sensitive word. Its novelty is the number of bytes by which the
compressed text around it (``context`` characters before and behind) grows when the candidate is added, with a
zstandard dictionary of common identifiers as prime: words and identifiers cost a byte or two, keys nearly their entropy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|auth|bearer|credential|signature)s?[A-Za-z_-]{0,12}["']?[\x20\t]{0,4}(?:[:=]{1,2}>?|\bis\b)?[\x20\t]{0,4}["'`]?([A-Za-z0-9+/_=.~!@#$%^&*-]{12,})""", re.ASCII | re.IGNORECASE)
#: A cheap superset of what the patterns can match in; texts without it are passed over.
HINT = r"(?i:passw|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|auth|bearer|credential|signature)|AKIA|[0-9a-f]{24}"
#: Common identifiers and glue of source code: fixed values, the prime of every compression.
IDENTIFIERS = b"""
import from return function const let var public private static final void class struct string number boolean
true false null none undefined self this new delete async await yield raise throw catch except finally
password passwd username user_name user_id account_id client_id client_secret access_token refresh_token
api_key apikey secret_key private_key public_key auth_token authorization bearer session_id csrf_token
config settings environment process.env os.environ getenv example changeme placeholder your_token_here
localhost http:// https:// www. .com .org .net /api/v1/ application/json content-type user-agent
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000 xxxxxxxx ********
the and that with this for from have which will would there their about other
"""


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    novelty: float  # marginal compressed bytes per character; 0 for the fixed patterns


class Novelty:
    """Marginal compressed bytes of a string given the text around it."""

    def __init__(self, level: int = 6):
        import zstandard

        prime = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=prime, write_content_size=False, write_checksum=False)

    def of(self, before: str, candidate: str, after: str) -> float:
        """Marginal bytes a character of the candidate behind the text on both sides of it."""
        a, x, b = (s.encode("utf-8", "replace") for s in (before, candidate, after))
        return (len(self.compressor.compress(a + b + x)) - len(self.compressor.compress(a + b))) / max(1, len(candidate))


def base_spans(text: str) -> list[Span]:
    out = [Span(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [Span(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text)]
    out += [Span(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, novelty: Novelty, least: float = 0.55, context: int = 256) -> list[Span]:
    """Base spans and the novel ones: an incompressible string after a sensitive word that no base span covers."""
    base = base_spans(text)
    out, k = list(base), 0
    furthest = 0  # the greatest end of base spans that start at or before the candidate
    for m in SENSITIVE.finditer(text):
        s, e = m.span(1)
        while k < len(base) and base[k].start <= s:
            furthest = max(furthest, base[k].end)
            k += 1
        if furthest >= e:
            continue
        got = novelty.of(text[max(0, s - context) : s], m.group(1), text[e : e + context])
        if got >= least:
            out.append(Span(s, 3, e, got))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.55, digests: bool = False) -> DataFrame:
    """Secrets of every whole text: id, spans array<struct<kind, start, end, novelty>> by start, then kind.

    With ``digests``: id, n_assign, n_access, n_hex, base_sha256, spans (string). Positions are code points, ends
    exclusive. A null or empty text has no spans; a null id is kept; repeated rows give repeated results; columns
    other than the two named are not read.
    """

    def listed(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[x.kind]}:{x.start}:{x.end}" for x in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            found: list[list[Span]] = [[]] * batch.num_rows
            hit = pc.match_substring_regex(batch.column(1), HINT)
            rows = pc.indices_nonzero(pc.fill_null(hit, False))
            for k, text in zip(rows.to_pylist(), batch.column(1).take(rows).to_pylist(), strict=True):
                found[k] = all_spans(text, novelty, least)
            if digests:
                count = lambda n: pa.array([sum(x.kind == n for x in s) for s in found], pa.int64())
                sums = [hashlib.sha256(listed([x for x in s if x.kind < 3]).encode()).hexdigest() if s else empty for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), count(0), count(1), count(2), pa.array(sums), pa.array([listed(s) for s in found])], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            else:
                rows_ = [[{"kind": KINDS[x.kind], "start": x.start, "end": x.end, "novelty": x.novelty} for x in s] for s in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows_, kind)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string" if digests else "spans array<struct<kind: string, start: long, end: long, novelty: double>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {rest}").withColumnRenamed("id", id_col)

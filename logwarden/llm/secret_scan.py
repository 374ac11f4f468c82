"""Secrets in texts: fixed patterns, and Shannon entropy over sliding windows.

Candidate strings of each character class are scanned with a window of fixed
length. Counts per character and the sum of count*log2(count) are updated as one
character enters and one leaves, so a string costs linear time. Windows above the
entropy of their class are merged into spans; windows that touch a match of the
allow list and strings inside a base span of the same place are not reported. What
stands beside an allowed match in the same string is scanned like any other.

Everything is per row: nothing is shuffled, and a lost executor repeats its rows.

Defined results: a null or empty text has no secrets and the digest of the empty
string; equal starts are ordered by kind as listed in ``KINDS``; repeated rows and
rows without id are scanned like any other; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy-hex", "entropy-base64")
# fixed values: the base patterns and the lengths their matches need
ASSIGN = re.compile(
    r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter one holds no match
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
_WORDS = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    candidate: re.Pattern
    window: int
    bits: float  # a window with at least this entropy is a secret
    needs: tuple[re.Pattern, ...]  # kinds of characters the window must hold


_DIGIT, _LOWER, _UPPER = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
CLASSES = (
    EntropyClass("entropy-hex", re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{16,}|[0-9A-F]{16,})(?![A-Za-z0-9])"), 16, 3.0,
                 (_DIGIT, re.compile("[A-Fa-f]"))),
    EntropyClass("entropy-base64", re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), 20, 3.7, (_DIGIT, _LOWER, _UPPER)),
)
# strings that look random and are public by their form
ALLOWED = (
    re.compile(r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|your[_-]"),
    re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    re.compile(r"(?i)0123456789|abcdefghij|(.)\1{7,}"),
)
_CLOG = [0.0, *(c * math.log2(c) for c in range(1, 257))]


def high_entropy(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged stretches of the windows whose entropy is at least ``bits``."""
    if len(text) < window:
        return []
    counts: dict[str, int] = {}
    total, found = 0.0, []
    # entropy = log2(window) - sum(c * log2(c)) / window
    most = (math.log2(window) - bits) * window + 1e-9
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _CLOG[n + 1] - _CLOG[n]
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += _CLOG[n - 1] - _CLOG[n]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([start, i + 1])
    return [(a, b) for a, b in found]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, kind by kind."""
    found = []
    lower = text.lower()
    # lower() may change lengths, but never hides one of these ASCII words
    if any(w in lower for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def entropy_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans by entropy outside the base spans."""
    found = []
    for one in CLASSES:
        for m in one.candidate.finditer(text):
            string = m[0]
            if not all(p.search(string) for p in one.needs):
                continue
            for x, y in open_parts(string):
                for a, b in high_entropy(string[x:y], one.window, one.bits):
                    a, b = a + x + m.start(), b + x + m.start()
                    if all(p.search(text, a, b) for p in one.needs) and not any(c <= a and b <= d for _, c, d in base):
                        found.append((one.kind, a, b))
    return found


def open_parts(string: str) -> list[tuple[int, int]]:
    """What the matches of the allow list leave between them."""
    parts, at = [], 0
    for a, b in sorted(m.span() for p in ALLOWED for m in p.finditer(string)):
        parts.append((at, a))
        at = max(at, b)
    return [*parts, (at, len(string))]


def joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of one text."""
    base = base_spans(text or "")
    return base, base + entropy_spans(text or "", base)


SCHEMA = pa.schema([
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
])


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, counts per base kind, digest of the base spans, and all spans, one row per row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for body in batch.column(1):
                base, spans = scan(body.as_py())
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)] if out else [
                pa.array([], f.type) for f in SCHEMA]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *SCHEMA.names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )

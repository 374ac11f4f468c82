"""Repeated token windows across documents, by Rabin-Karp hashes counted in Spark.

Each batch of documents hashes every window of ``WINDOW`` words with a rolling
polynomial. Hashes are dealt by their high bits into buckets, as compressed columns
(hash, document, place) that hold about ten bytes a window. Inside a batch a hash
is sent for its smallest document only, so a passage that a third of all documents
share arrives once per batch, not once per document; its other places are already
known to be repeats. A bucket then finds the smallest document of every hash and
returns the places of all others. Per document, places merge into maximal removal
intervals, which are applied where the text is read again.

Hashes have 80 bits: 64 of the rolling hash over word hashes and 16 of a second
polynomial. At 10^13 windows fewer than 10^-10 of them meet a wrong partner.

Defined results: a null text has no words; a row without id keeps all its words and
lends none; rows that repeat an id are cleaned each by its own text, without lending
to each other; documents of fewer words than a window keep them
all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import settle

WINDOW = 13
BUCKET_CHARS = 16_000_000  # text per bucket: two to three million windows at most times
BATCH_CHARS = 12_000_000
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEED = 7


def window_hashes(words: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes (64 and 16 bits) of every window of ``size`` words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    marks = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(_SEED))), "<u8")
    first, second = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    for k in range(size):  # Horner's rule for all windows at once
        part = marks[k : k + count]
        first = first * _BASE + part
        second = second * _BASE2 + (part ^ (part >> np.uint64(29)))
    first ^= first >> np.uint64(32)
    first *= _BASE
    return first, (second >> np.uint64(48)).astype(np.uint16)


def _planes(column: np.ndarray) -> bytes:
    """Bytes of a column, all first bytes first: sorted columns pack well that way."""
    return column.view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, count * size).reshape(size, count).T.copy().view(kind).ravel()


def pack(hashes: np.ndarray, extra: np.ndarray, docs: np.ndarray, variants: np.ndarray, places: np.ndarray) -> bytes:
    """One bucket's share of a batch; hashes ascend."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    low = int(docs.min())
    offsets = (docs - low).astype(np.uint64)
    columns = [np.array([low], np.int64).tobytes(), _planes(steps), _planes(extra), _planes(offsets), _planes(variants), _planes(places)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(columns))


def unpack(data: bytes, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    low = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8, []
    for kind in (np.uint64, np.uint16, np.uint64, np.uint32, np.uint32):
        out.append(_unplanes(raw[at:], kind, count))
        at += count * np.dtype(kind).itemsize
    steps, extra, offsets, variants, places = out
    return np.cumsum(steps, dtype=np.uint64), extra, offsets.astype(np.int64) + low, variants, places


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the row before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _owners(hashes: np.ndarray, extra: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For rows sorted by (hash, document): the document of the first row of the same hash."""
    begins = np.flatnonzero(_first_of_runs(hashes, extra))
    return np.repeat(docs[begins], np.diff(np.append(begins, len(docs))))


PARTS = "bucket int, n int, known boolean, data binary"
FOUND = "shard int, n int, data binary"
PLACES = "doc_id bigint, variant bigint, places binary"


def _rows(buckets: list, counts: list, known: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(counts, pa.int32()), pa.array(known, pa.bool_()),
         pa.array(data, pa.binary())], ["bucket", "n", "known", "data"])


def _by_document(docs: np.ndarray, variants: np.ndarray, places: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    order = np.lexsort((places, variants, docs))
    docs, variants, places = docs[order], variants[order], places[order].astype("<u4")
    begins = np.flatnonzero(_first_of_runs(docs, variants))
    packed = [p.tobytes() for p in np.split(places, begins[1:])] if len(begins) else []
    return docs[begins].tolist(), variants[begins].tolist(), packed


def _hash_batch(docs: list[int], kinds: list[int], texts: list[bytes | None], buckets: int) -> Iterator[pa.RecordBatch]:
    order = sorted(range(len(docs)), key=docs.__getitem__)
    hashed = [window_hashes((texts[i] or b"").split()) for i in order]
    sizes = [len(h) for h, _ in hashed]
    if not sum(sizes):
        return
    hashes, extra = (np.concatenate([x[k] for x in hashed]) for k in (0, 1))
    owner = np.repeat(np.array([docs[i] for i in order], np.int64), sizes)
    variants = np.repeat(np.array([kinds[i] for i in order], np.uint32), sizes)
    places = np.concatenate([np.arange(s, dtype=np.uint32) for s in sizes])
    del hashed
    by = np.argsort(hashes, kind="stable")  # documents ascend within a hash
    hashes, extra, owner, variants, places = hashes[by], extra[by], owner[by], variants[by], places[by]
    if (_first_of_runs(hashes) != _first_of_runs(hashes, extra)).any():
        by = np.lexsort((owner, extra, hashes))
        hashes, extra, owner, variants, places = hashes[by], extra[by], owner[by], variants[by], places[by]
    repeats = _owners(hashes, extra, owner) < owner
    if repeats.any():
        yield from _known(owner[repeats], variants[repeats], places[repeats], buckets)
        hashes, extra, owner, variants, places = (c[~repeats] for c in (hashes, extra, owner, variants, places))
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    begins = np.flatnonzero(_first_of_runs(bucket))
    ends = [*begins[1:].tolist(), len(bucket)]
    for a, b in zip(begins.tolist(), ends):
        data = pack(hashes[a:b], extra[a:b], owner[a:b], variants[a:b], places[a:b])
        yield _rows([int(bucket[a])], [b - a], [False], [data])


def _known(docs: np.ndarray, variants: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Repeats found inside a batch travel with the buckets, spread by document."""
    ids, kinds, packed = _by_document(docs, variants, places)
    head = [np.array([i, k], np.int64).tobytes() + p for i, k, p in zip(ids, kinds, packed)]
    yield _rows([i % buckets for i in ids], [0] * len(ids), [True] * len(ids), head)


def hash_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """Windows of ``docs(doc_id, variant, text)`` as compressed parts of buckets."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        kinds: list[int] = []
        texts: list[bytes | None] = []
        size = 0
        for batch in rows:
            columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            for doc, kind, text in zip(*columns):
                ids.append(doc)
                kinds.append(kind)
                texts.append(text)
                size += len(text or b"")
                if size > BATCH_CHARS:
                    yield from _hash_batch(ids, kinds, texts, buckets)
                    ids, kinds, texts, size = [], [], [], 0
        yield from _hash_batch(ids, kinds, texts, buckets)

    return docs.mapInArrow(run, PARTS)


def _shards(docs: np.ndarray, variants: np.ndarray, places: np.ndarray, count: int) -> pa.Table:
    """Repeats of one bucket, packed by shards of documents: rows stay few however many documents there are."""
    shard = (docs % count).astype(np.int32)
    order = np.lexsort((places, variants, docs, shard))
    shard, docs, variants, places = shard[order], docs[order], variants[order], places[order]
    begins = np.flatnonzero(_first_of_runs(shard))
    packer, sizes, data = zstandard.ZstdCompressor(level=1), [], []
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(shard)]):
        steps = np.diff(docs[a:b], prepend=np.int64(0))
        data.append(packer.compress(_planes(steps) + _planes(variants[a:b]) + _planes(places[a:b])))
        sizes.append(b - a)
    return pa.table({"shard": pa.array(shard[begins], pa.int32()), "n": pa.array(sizes, pa.int32()),
                     "data": pa.array(data, pa.binary())})


def _meet(parts: pa.Table, shards: int) -> pa.Table:
    """Repeated places of one bucket."""
    known = parts.column("known").to_pylist()
    data, counts = parts.column("data").to_pylist(), parts.column("n").to_pylist()
    found = [(np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32))]
    for d, k in zip(data, known):
        if k:
            where = np.frombuffer(d, "<u4", offset=16)
            doc, variant = np.frombuffer(d, np.int64, 2).tolist()
            found.append((np.full(len(where), doc, np.int64), np.full(len(where), variant, np.uint32), where))
    opened = [unpack(d, n) for d, n, k in zip(data, counts, known) if not k]
    if opened:
        hashes, extra, docs, variants, where = (np.concatenate([x[k] for x in opened]) for k in range(5))
        del opened
        order = np.lexsort((docs, extra, hashes))
        hashes, extra, docs, variants, where = hashes[order], extra[order], docs[order], variants[order], where[order]
        repeats = _owners(hashes, extra, docs) < docs
        found.append((docs[repeats], variants[repeats], where[repeats]))
    return _shards(*(np.concatenate([f[k] for f in found]) for k in range(3)), shards)


def _gather(parts: pa.Table) -> pa.Table:
    """All repeated places of the documents of one shard."""
    docs, variants, places, tool = [], [], [], zstandard.ZstdDecompressor()
    for data, n in zip(parts.column("data").to_pylist(), parts.column("n").to_pylist()):
        raw = tool.decompress(data)
        docs.append(np.cumsum(_unplanes(raw, np.int64, n)))
        variants.append(_unplanes(raw[8 * n :], np.uint32, n))
        places.append(_unplanes(raw[12 * n :], np.uint32, n))
    ids, kinds, packed = _by_document(np.concatenate(docs), np.concatenate(variants), np.concatenate(places))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "variant": pa.array(kinds, pa.int64()),
                     "places": pa.array(packed, pa.binary())})


def intervals(places: np.ndarray, size: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal word intervals (end exclusive) covered by windows that start at ``places``."""
    if not len(places):
        return []
    places = np.unique(places).astype(np.int64)
    cuts = np.flatnonzero(places[1:] > places[:-1] + size)
    starts = places[np.concatenate(([0], cuts + 1))]
    ends = places[np.append(cuts, len(places) - 1)] + size
    return list(zip(starts.tolist(), ends.tolist()))


CLEANED = "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start:bigint,end:bigint>>"


def _clean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in rows:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "removed": []}
        for text, places in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            words = (text or b"").split()
            cut = intervals(np.frombuffer(places, "<u4")) if places else []
            kept, at = [], 0
            for a, b in cut:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept).decode())
            out["removed"].append([{"start": a, "end": b} for a, b in cut])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
             pa.array(out["kept"], pa.string()), pa.array(out["removed"], span)],
            ["doc_id", "n_words", "n_removed", "kept", "removed"])


def with_variants(docs: DataFrame) -> DataFrame:
    """``doc_id, variant, text``: the texts of an id are numbered from 0, so rows that share an id are told apart."""
    marked = docs.withColumn("_h", F.xxhash64("text"))
    several = marked.filter("doc_id is not null").groupBy("doc_id").agg(F.min("_h").alias("low"), F.max("_h").alias("high"))
    several = settle(several.filter("low <> high").select("doc_id"), "several")
    if several.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("variant"), "text")
    texts = marked.select("doc_id", "_h").distinct().join(several, "doc_id")
    order = Window.partitionBy("doc_id").orderBy("_h")
    numbered = settle(texts.withColumn("variant", F.row_number().over(order).cast("bigint") - 1), "variants")
    return marked.join(numbered, ["doc_id", "_h"], "left").select("doc_id", F.coalesce("variant", F.lit(0)).alias("variant"), "text")


def repeated_places(docs: DataFrame) -> DataFrame:
    """``doc_id, variant, places``: where windows start that also start in a document with a smaller id."""
    known = docs.filter("doc_id is not null")
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_CHARS))
    parts = hash_windows(known, buckets).repartition(buckets, "bucket")
    found = parts.groupBy("bucket").applyInArrow(lambda table: _meet(table, buckets), FOUND)
    return settle(found.groupBy("shard").applyInArrow(_gather, PLACES), "places")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (words joined by blanks) and ``removed`` intervals of every row."""
    rows = with_variants(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    marked = rows.join(repeated_places(rows), ["doc_id", "variant"], "left")
    return marked.select("doc_id", "text", "places").mapInArrow(_clean, CLEANED)

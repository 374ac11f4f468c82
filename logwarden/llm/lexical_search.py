"""Ranked lexical search over a sharded inverted index, by Block-Max MaxScore.

Terms are the runs of letters, digits and non-ASCII characters of a text, A-Z
lower-cased. The score of a document is the sum of integer weights of the query's
terms (see ``term_weight`` and ``impacts``), so every sum is exact.

The index is a table: for each shard (a bounded group of documents, in order of their
ids) and term the postings in blocks of ``BLOCK``, packed as byte varints, with the
largest impact and the last document of each block. All terms of all documents are
indexed, from whole texts; texts are never shuffled.

A search reads the lists of the query's terms only. Inside a shard the bounds of whole
lists split them: as long as the smallest lists together stay below the score a
document needs, only documents of the other, essential lists are candidates. Candidates
then meet the small lists from the largest bound down, and the maximum of the block
where a candidate would stand rejects it before that block is unpacked. A task carries
the best documents of its shards from one to the next, and Spark merges what the tasks
found (Turtle and Flood 1995; Ding and Suel 2011).

Queries are a stated set. They go through in blocks of ``QUERY_BLOCK`` rows, so what
reaches the tasks is bounded whatever the size of the set.

Defined results: a null or empty text has no terms and is never found, an item without
known terms finds nothing; documents of equal score stand by ascending id, null ids
last; rows that repeat an id are ranked each by itself; repeated items count once, items
that share an id are ranked each by itself; an empty table on either side gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import settle

TOP = 50
BLOCK = 128
WINDOW = 2_048  # documents scored between two looks at the needed score
SHARD_BYTES = 12_000_000  # of text, unless one document is longer
QUERY_BLOCK = 1_000
_LAST = np.iinfo(np.int64).max  # place of a null id in the order
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of one text in UTF-8."""
    return (text or b"").translate(_TERMS).split()


def term_weight(total: int, found: int) -> int:
    """Weight of a term that ``found`` of ``total`` documents hold."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * found + 1)))


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What one unit of weight gains in a document: ``norm`` is the document's m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


def _norms(lengths: np.ndarray, total: int, all_terms: int) -> np.ndarray:
    return 100 - 50 + (50 * lengths * total) // max(all_terms, 1)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as varints, and the byte at which each begins, with the end as last entry."""
    size = 1 + sum((values >= (1 << bits)).astype(np.int64) for bits in (7, 14, 21, 28, 35))
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    for k in range(6):
        longer = np.flatnonzero(size > k)
        more = np.where(size[longer] > k + 1, 128, 0)
        out[starts[longer] + k] = ((values[longer] >> (7 * k)) & 127) | more
    return out, starts


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    inside = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * inside), starts)


@dataclass
class Postings:
    """The list of one term in a shard; blocks are unpacked when they are first needed."""

    found: int
    most: np.ndarray  # of each block
    ends: np.ndarray  # last document of each block
    at: np.ndarray  # first byte of each block
    data: bytes
    norm: np.ndarray

    def __post_init__(self) -> None:
        self.top = int(self.most.max())
        # a block that is still packed stands as copies of its last document, which keeps the order
        self.docs = np.repeat(self.ends, BLOCK)[: self.found]
        self.gain = np.zeros(self.found, np.int64)
        self.open = np.zeros(len(self.ends), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.open[blocks]].tolist():
            stop = self.at[b + 1] if b + 1 < len(self.at) else len(self.data)
            values = unpack(self.data[self.at[b] : stop])
            docs = np.cumsum(values[::2]) + (self.ends[b - 1] if b else 0)
            rows = slice(b * BLOCK, b * BLOCK + len(docs))
            self.docs[rows], self.gain[rows] = docs, impacts(values[1::2], self.norm[docs])
            self.open[b] = True

    def add(self, low: int, high: int, weight: int, scores: np.ndarray, seen: np.ndarray) -> None:
        """Add the gains of all documents from ``low`` to ``high``."""
        first, last = np.searchsorted(self.ends, (low, high))
        self.unpack(np.arange(first, min(last + 1, len(self.ends))))
        rows = slice(*np.searchsorted(self.docs, (low, high)))
        places = self.docs[rows] - low
        scores[places] += weight * self.gain[rows]
        seen[places] = True


@dataclass
class Best:
    """The best documents of one item so far."""

    scores: np.ndarray
    ids: np.ndarray
    top: int

    def needed(self) -> int:
        """The least score that can still enter; an equal one may, by its id."""
        return max(int(self.scores[-1]), 1) if len(self.scores) >= self.top else 1

    def push(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]


def search_shard(lists: list[tuple[Postings, int]], ids: np.ndarray, best: Best) -> None:
    """Block-Max MaxScore of one item over one shard; ``lists`` are (postings, weight)."""
    lists = sorted(lists, key=lambda x: x[0].top * x[1])
    below = np.concatenate([[0], np.cumsum([p.top * w for p, w in lists])]).astype(np.int64)
    for low in range(0, len(ids), WINDOW):
        high, needed = min(low + WINDOW, len(ids)), best.needed()
        essential = int(np.searchsorted(below[1:], needed))  # the lists before it cannot reach the score together
        if essential == len(lists):
            continue
        scores, seen = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for p, w in lists[essential:]:
            p.add(low, high, w, scores, seen)
        docs = np.flatnonzero(seen) + low
        scores = scores[docs - low]
        for j in range(essential - 1, -1, -1):
            p, w = lists[j]
            hopeful = scores + below[j + 1] >= needed
            docs, scores = docs[hopeful], scores[hopeful]
            if not len(docs):
                break
            block = np.searchsorted(p.ends, docs)
            listed = block < len(p.ends)
            bound = np.where(listed, w * p.most[np.minimum(block, len(p.ends) - 1)], 0)
            hopeful = scores + bound + below[j] >= needed
            docs, scores, block, listed = docs[hopeful], scores[hopeful], block[hopeful], listed[hopeful]
            p.unpack(np.unique(block[listed]))
            at = np.minimum(np.searchsorted(p.docs, docs), p.found - 1)
            scores = scores + np.where(listed & (p.docs[at] == docs), w * p.gain[at], 0)
        enough = scores >= needed
        if enough.any():
            best.push(scores[enough], ids[docs[enough]])


INDEX = "shard string, term binary, found int, most array<int>, ends array<int>, at array<int>, data binary"
_NAMES = [f.split()[0] for f in INDEX.split(", ")]


def _shard(name: str, ids: np.ndarray, texts: list[bytes], total: int, all_terms: int) -> Iterator[pa.RecordBatch]:
    """Index rows of a group of documents; the row without a term holds ids and norms."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    data = b" \n ".join(texts[i].translate(_TERMS) for i in order) + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    cells = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = cells.dictionary_encode()
    number, words = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}, coded.dictionary
    codes = coded.indices.to_numpy().astype(np.int64)
    doc = np.cumsum(codes == number.get(b"\n ", -1))
    real = (codes != number.get(b"\n ", -1)) & (codes != number.get(b" ", -1))
    codes, doc = codes[real], doc[real]
    norm = _norms(np.bincount(doc, minlength=len(ids)), total, all_terms)
    yield pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([b""]), pa.array([len(ids)], pa.int32()), *[pa.array([[]], pa.list_(pa.int32()))] * 3,
         pa.array([ids.tobytes() + norm.tobytes()])], _NAMES)
    if not len(codes):
        return
    keys, tf = np.unique(codes * len(ids) + doc, return_counts=True)
    term, docs = keys // len(ids), keys % len(ids)
    gain = impacts(tf, norm[docs])
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    found = np.diff(np.append(begins, len(term)))
    gaps = np.diff(docs, prepend=0)
    gaps[begins] = docs[begins]
    packed, starts = pack(np.column_stack([gaps, tf]).ravel())
    blocks = -(-found // BLOCK)
    block_lists = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(begins)), blocks)
    first = begins[owner] + BLOCK * (np.arange(block_lists[-1]) - block_lists[owner])
    last = np.minimum(first + BLOCK, (begins + found)[owner]) - 1
    columns = [np.maximum.reduceat(gain, first), docs[last], starts[2 * first] - starts[2 * begins][owner]]
    cut = pa.array(block_lists, pa.int32())
    lists = np.append(starts[2 * begins], starts[-1]).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(lists), pa.py_buffer(packed.tobytes())])
    # a term goes without the blank that ends it
    names = pa.array([w[:-1] for w in words.take(pa.array(term[begins])).to_pylist()], pa.binary())
    rows = pa.RecordBatch.from_arrays(
        [pa.array([name]).take(pa.array(np.zeros(len(begins), np.int8))), names, pa.array(found, pa.int32()),
         *[pa.ListArray.from_arrays(cut, pa.array(c.astype(np.int32))) for c in columns], chunks.cast(pa.binary())], _NAMES)
    for start in range(0, len(rows), 20_000):
        yield rows.slice(start, 20_000)


@dataclass(frozen=True)
class LexicalIndex:
    table: DataFrame  # INDEX
    total: int  # documents with a term
    terms: int  # their terms, with repeats


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """Index every document of ``docs``; the table is written to the shared folder."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(terms_of(t)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"total": [sum(c > 0 for c in counts)], "terms": [sum(counts)]})

    sums = rows.select("text").mapInArrow(measure, "total bigint, terms bigint").agg(F.sum("total"), F.sum("terms")).first()
    total, all_terms = sums[0] or 0, sums[1] or 0

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number = [], [], 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(_LAST if key is None else key)
                texts.append(text)
                size += len(text)
                if size >= SHARD_BYTES:
                    yield from _shard(f"{part}-{number}", np.array(ids, np.int64), texts, total, all_terms)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield from _shard(f"{part}-{number}", np.array(ids, np.int64), texts, total, all_terms)

    return LexicalIndex(settle(rows.mapInArrow(index, INDEX), "index"), total, all_terms)


def _ranked(index: LexicalIndex, items: list[tuple[int, int | None, list[bytes]]], top: int) -> DataFrame:
    """``item, item_id, doc_id, score``: the best documents that the tasks found for a block of items."""
    spark = index.table.sparkSession
    wanted = sorted({t for _, _, terms in items for t in terms})
    schema = "term binary, number int"
    words = spark.createDataFrame([(bytearray(t), i) for i, t in enumerate(wanted)], schema)
    # a block of items bounds the words, so they are broadcast
    lists = index.table.join(F.broadcast(words), "term")
    held = {r.number: r.n for r in lists.groupBy("number").agg(F.sum("found").alias("n")).collect()}
    weights = {i: term_weight(index.total, n) for i, n in held.items()}
    place = {t: i for i, t in enumerate(wanted)}
    queries = [(key, item, [place[t] for t in terms if weights.get(place[t], 0) > 0]) for key, item, terms in items]
    frames = index.table.filter(F.octet_length("term") == 0).withColumn("number", F.lit(-1))
    read = lists.unionByName(frames).select("shard", "number", "found", "most", "ends", "at", "data")
    dealt = read.repartition("shard").sortWithinPartitions("shard", "number")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(np.empty(0, np.int64), np.empty(0, np.int64), top) for _ in queries]
        ids = norm = np.empty(0, np.int64)
        postings: dict[int, Postings] = {}

        def finish() -> None:
            for (_, _, terms), b in zip(queries, best):
                lists = [(postings[t], weights[t]) for t in terms if t in postings]
                if lists:
                    search_shard(lists, ids, b)

        for batch in batches:
            columns = [batch.column(i) for i in range(1, 7)]
            for row in range(batch.num_rows):
                number = columns[0][row].as_py()
                if number < 0:  # a new shard
                    finish()
                    both = np.frombuffer(columns[5][row].as_py(), np.int64)
                    ids, norm = both[: len(both) // 2], both[len(both) // 2 :]
                    postings = {}
                    continue
                arrays = [c[row].values.to_numpy().astype(np.int64) for c in columns[2:5]]
                postings[number] = Postings(columns[1][row].as_py(), *arrays, columns[5][row].as_py(), norm)
        finish()
        for (key, item, _), b in zip(queries, best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(b.ids), pa.int64()), pa.array([item] * len(b.ids), pa.int64()),
                     pa.array([None if i == _LAST else i for i in b.ids.tolist()], pa.int64()), pa.array(b.scores)],
                    ["item", "item_id", "doc_id", "score"])

    return dealt.mapInArrow(search, "item bigint, item_id bigint, doc_id bigint, score bigint")


def search(
    index: LexicalIndex, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item with a score above 0."""
    rows = items.select(F.xxhash64(F.col(item_id), F.col(text)).alias("item"), F.col(item_id).cast("bigint").alias("item_id"),
                        F.col(text).cast("string").alias("text"))
    # items equal in id and text are one
    rows = settle(rows.dropDuplicates(["item"]), "items")
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    found = []
    for block in range(blocks):
        mine = rows.filter(F.pmod("item", F.lit(blocks)) == block).collect()
        queries = [(r.item, r.item_id, sorted(set(terms_of((r.text or "").encode())))) for r in mine]
        found.append(_ranked(index, queries, top))
    merged = settle(reduce(DataFrame.unionByName, found), "found")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")

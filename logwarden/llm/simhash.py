"""SimHash near-duplicates through tables of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to a fixed table of pivots:
some random references, and each reference again with one block of bits inverted.
By the triangle inequality two fingerprints within ``radius`` differ by at most
``radius`` in every coordinate. The distances to a reference and to its inverted
twin also give the distance inside the block alone, and two fingerprints within a
radius of 2 agree in at least two of four blocks, hence in all coordinates of those
two. So candidates meet on equal coordinates of two blocks (never on all pairs),
pairs are discarded by their largest coordinate difference, and survivors are
verified bit by bit.

A key shared by very many different fingerprints (thousands of near copies) would
make too many pairs. Its fingerprints are linked through their midpoints instead:
two values within two bits have a common neighbour within one bit, and a
neighbourhood holds at most 65 values, so work stays linear and no link is lost.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; equal texts and repeated rows share a fingerprint; a row without id
takes the group of its fingerprint, or null if no row with an id has it, and links
nothing; ties at half the shingles leave the bit 0; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import settle
from logwarden.operators.components import components

BITS = 64
RADIUS = 2
BLOCKS = 4  # radius 2 leaves two of four blocks untouched
REFERENCES = 8
SHINGLE = 3
SEED = 42
DENSE = 64  # a key with more fingerprints is linked by midpoints
HOT_KEYS = 500
HOT_LEAST = 1_000
SLICES = 64
_ROWS = 1 << 14
_TEXTS = 200  # texts a worker holds as objects


def shingle_digests(text: bytes | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Digests of the shingles of one text in UTF-8, repeats included, eight bytes a row, some rows at a time."""
    words = (text or b"").lower().split()  # both work on ASCII only
    if not words:
        return
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total = len(words) - size + 1
    for at in range(0, total, _ROWS):
        stop = min(total, at + _ROWS)
        cut = [joined[a : b - 1] for a, b in zip(starts[at:stop], ends[at + size - 1 : stop + size - 1])]
        yield np.frombuffer(b"".join(map(xxhash.xxh64_digest, cut, repeat(SEED))), np.uint8).reshape(-1, 8)


def majority(digests: Iterable[np.ndarray]) -> int:
    """Unsigned fingerprint: a bit is set if it is in over half the digests."""
    votes, total = np.zeros(BITS, np.int64), 0
    for part in digests:
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of one text in UTF-8."""
    return majority(shingle_digests(text))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(start, _TEXTS)
            marks = np.array([fingerprint(t) for t in part.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks.view(np.int64))], ["doc_id", "mark"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark`` (the fingerprint as a signed long) of every row."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, mark bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _masks() -> list[int]:
    width = BITS // BLOCKS
    return [((1 << width) - 1) << (width * b) for b in range(BLOCKS)]


def pivots() -> list[int]:
    """Reference fingerprints: each random reference, then its twins with one block inverted."""
    draw = random.Random(SEED)
    return [_signed(p ^ m) for p in (draw.getrandbits(BITS) for _ in range(REFERENCES)) for m in (0, *_masks())]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_row(mark: Column) -> Column:
    """Distances of a fingerprint to all pivots: its row of the pivot table."""
    return F.array(*[_distance(mark, F.lit(p)).cast("tinyint") for p in pivots()])


def _keys(row: Column) -> Column:
    """For every two blocks a key of their coordinates, derived from the pivot table."""
    step = BLOCKS + 1

    def inside(b: int) -> list[Column]:
        return [F.get(row, F.lit(r * step + b + 1)) - F.get(row, F.lit(r * step)) for r in range(REFERENCES)]

    pairs = combinations(range(BLOCKS), BLOCKS - RADIUS)
    return F.array(*[F.xxhash64(F.lit(k), *[c for b in pair for c in inside(b)]) for k, pair in enumerate(pairs)])


def _close(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= RADIUS)


def links(marks: DataFrame) -> DataFrame:
    """Links that connect all of ``marks(rep, mark)`` within the radius, as ``a, b``.

    Marks are distinct. Sparse keys give every pair within the radius; dense ones
    give enough pairs to connect the same fingerprints.
    """
    table = marks.withColumn("_row", pivot_row(F.col("mark")))
    keyed = settle(table.select("rep", "mark", F.explode(_keys(F.col("_row"))).alias("key")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = settle(keyed.join(shared, "key"))

    sparse = met.filter(F.col("n") <= DENSE).withColumn("_row", pivot_row(F.col("mark")))
    left, right = (sparse.select("key", *[F.col(c).alias(s + c) for c in ("rep", "mark", "_row")]) for s in "ab")
    pairs = left.join(
        right,
        (left["key"] == right["key"]) & (F.col("amark") < F.col("bmark")) & _close(F.col("a_row"), F.col("b_row")),
    ).filter(_distance(F.col("amark"), F.col("bmark")) <= RADIUS)
    direct = pairs.select(F.col("arep").alias("a"), F.col("brep").alias("b"))

    dense = met.filter(F.col("n") > DENSE).select("rep", "mark").distinct()
    flips = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    middles = dense.select("rep", F.col("mark"), F.explode(flips).alias("_flip")).select(
        "rep", F.col("mark").bitwiseXOR(F.col("_flip")).alias("middle")
    )
    hub = F.min("rep").over(Window.partitionBy("middle"))  # a middle has at most 65 rows
    stars = middles.select(F.col("rep").alias("a"), hub.alias("b")).filter("a <> b")
    return direct.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id that can be reached over links.
    """
    marked = settle(fingerprints(docs, doc_id, text), "marks")
    groups = settle(
        marked.filter("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    )
    roots = components(links(groups.select("rep", "mark"))).select(F.col("node").alias("rep"), "root")
    classes = groups.join(roots, "rep", "left").select("mark", "n", F.coalesce("root", "rep").alias("component_id"))
    joined = join_hot(marked, settle(classes), "mark")
    digits = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    return joined.select("doc_id", digits.alias("fingerprint"), "component_id")


def join_hot(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Left join ``classes`` (one row per key; ``n`` counts its rows) with hot keys cut into slices by id.

    A key is hot above a five-hundredth of all rows, so there are at most 500 hot
    keys at any size; their class is copied to every slice.
    """
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in classes.filter(F.col("n") > max(HOT_LEAST, total // HOT_KEYS)).select(key).collect()]
    if not hot:
        return rows.join(classes.drop("n"), key, "left")
    is_hot = F.col(key).isin(hot)
    slices = F.array(*[F.lit(i) for i in range(SLICES)])
    copies = classes.drop("n").withColumn("_slice", F.explode(F.when(is_hot, slices).otherwise(F.array(F.lit(0)))))
    cut = F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int")).otherwise(F.lit(0))
    return rows.withColumn("_slice", cut).join(copies, [key, "_slice"], "left").drop("_slice")


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the smallest of their group, columns unchanged.

    Rows without id stay.
    """
    found = near_duplicates(docs)
    losers = settle(found.filter(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct())
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)

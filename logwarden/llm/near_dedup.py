"""One document of each near-duplicate group: SimHash links, MinHash for the rest, exact check.

A text is the set of its five-word shingles (op1's words; a shorter text is one
shingle). Two texts are near copies if these sets have a Jaccard similarity of at
least 0.8; groups are what can be reached over such pairs. Equal sets are handled
once. Links come from op1's operator: SimHash fingerprints of the sets meet over
its pivot table, and candidates are discarded by their largest coordinate
difference. Two sets at 0.8 differ in about ten of 64 bits, which no radius that
still tells texts apart covers, so what fingerprints leave apart is found by MinHash:
candidates share one of ``BANDS`` keys of ``ROWS`` minima each; a pair at exactly
0.8 has none in common once in eight million, a closer pair less often.

Every key first links its members to one of them. Members that are in different
groups after that meet in cells: a key is cut into slices of bounded size, and a
cell compares two slices by counting common shingles for all its pairs at once. A
cell gives out no more links than it has members, keys with the same members are
compared once, and cells of one group only are skipped, so no pair within the
similarity is left out and none is written down to be compared. Every link is
verified on the sets themselves.

Defined results: null and empty texts are equal sets; the smallest id of a group
stays, rows without id come last, then the hash of the text decides; rows are told
apart by id and text, never by id alone, and of rows alike in both one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.config import Settings
from logwarden.llm.common import drop_tools, settle
from logwarden.llm.simhash import join_hot, links, majority, shingle_digests
from logwarden.operators.components import components
from logwarden.operators.joins import attach

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
SEED = 42
KEYS = Settings(broadcast_rows=1_000_000)  # rows of texts that are read again: three numbers each, and measured
SLICE = 1 << 18  # shingles of a slice, about
LEAST = 1 << 10  # what a member counts for at least, so that a slice has about 256 members
TEXTS, BYTES = 200, 2_000_000  # texts whose sets a worker holds at once, at most
_CHUNK = 2_000
_COLUMNS = 1 << 13  # shingles compared at once
_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text in UTF-8."""
    parts = [d.view(np.uint64).ravel() for d in shingle_digests(text, SHINGLE)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def band_keys(marks: np.ndarray) -> list[int]:
    """Keys of the minima of a set, band by band; none for an empty set."""
    if not len(marks):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(marks), _CHUNK):
        mixed = (marks[None, at : at + _CHUNK] + _PLUS[:, None]) * _TIMES[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), seed=b) for b, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Some rows at a time with the shingles of their texts (the second column); one text is an object at once."""
    drop_tools()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, min(start + TEXTS, int(np.searchsorted(sizes, before + BYTES, side="right"))))
            part = batch.slice(start, stop - start)
            yield part, [shingle_set(t.as_py()) for t in part.column(1).cast(pa.binary())]
            start = stop


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _texts(batches):
        marks = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) for s in sets], np.uint64).view(np.int64)
        fingers = np.array([majority([s.view(np.uint8).reshape(-1, 8)]) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.array(marks), pa.array(fingers), pa.array([len(s) for s in sets], pa.int32()),
             pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))],
            ["doc_id", "row", "mark", "finger", "size", "keys"])


def _only_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _texts(batches):
        shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), shingles], ["mark", "shingles"])


def _sets_of(marks: DataFrame, holders: DataFrame, texts: DataFrame) -> DataFrame:
    """``mark, shingles, n`` of ``marks(mark, n)``: only their texts are read again, one for each.

    ``holders(mark, row, again)`` names a row that has the set and whether there are more such rows,
    ``texts(row, text)`` are all rows. Rows that come once are not shuffled as texts.
    """
    wanted = settle(marks.join(holders, "mark").select("row", "mark", "n", "again"))
    read = attach(texts, wanted, ["row"], how="inner", settings=KEYS)
    if not wanted.filter("again").isEmpty():
        read = read.filter("not again").unionByName(read.filter("again").dropDuplicates(["row"]))
    built = read.select("mark", "text").mapInArrow(_only_sets, "mark bigint, shingles array<bigint>")
    return settle(built.join(marks, "mark"), "sets")


def _fingerprint_links(sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``sets(mark, finger)`` that op1's operator links: equal and near fingerprints."""
    groups = settle(sets.groupBy("finger").agg(F.min("mark").alias("rep"), F.count("*").alias("n")))
    near = links(groups.select("rep", F.col("finger").alias("mark")))
    # join_hot slices a hot key by doc_id: here the set
    named = join_hot(sets.select(F.col("mark").alias("doc_id"), "finger"), groups, "finger")
    equal = named.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return near.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verified(pairs: DataFrame, holders: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    pairs = settle(pairs.distinct())
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("mark")).groupBy("mark").agg(F.count("*").alias("n")))
    held = _sets_of(ends, holders, texts)
    # join_hot slices a hot key by doc_id: here the other end of the pair
    one = join_hot(pairs.select("a", F.col("b").alias("doc_id")),
                   held.select(F.col("mark").alias("a"), "n", F.col("shingles").alias("_a")), "a")
    both = join_hot(one.select("_a", F.col("a").alias("doc_id"), F.col("doc_id").alias("b")),
                    held.select(F.col("mark").alias("b"), "n", F.col("shingles").alias("_b")), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    similarity = common / (F.size("_a") + F.size("_b") - common)
    return settle(both.filter(similarity >= SIMILARITY).select(F.col("doc_id").alias("a"), "b"))


def _near_in_size(a: str, b: str):
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of ``left`` with each of ``right``."""
    out = np.zeros((len(left), len(right)))
    (one, of_one), (two, of_two) = (
        (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])) for sets in (left, right))
    shared = np.intersect1d(one, two)
    sides = []
    for marks, owner in ((one, of_one), (two, of_two)):
        at = np.searchsorted(shared, marks)
        known = shared[np.minimum(at, len(shared) - 1)] == marks if len(shared) else np.zeros(len(marks), bool)
        at, owner = at[known], owner[known]
        order = np.argsort(at)
        sides.append((at[order], owner[order]))
    for start in range(0, len(shared), _COLUMNS):
        tables = []
        for (at, owner), sets in zip(sides, (left, right)):
            a, b = np.searchsorted(at, (start, start + _COLUMNS))
            table = np.zeros((len(sets), min(_COLUMNS, len(shared) - start)), np.float32)
            table[owner[a:b], at[a:b] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _meet(cell: pa.Table) -> pa.Table:
    """Links that join the groups of a cell, at most one for each member."""
    own, low, high, marks, roots = (cell.column(c).to_numpy() for c in ("own", "low", "high", "mark", "root"))
    sets = [x.values.to_numpy() for x in cell.column("shingles")]
    one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
    links: list[tuple[int, int]] = []
    if len(one) and len(two):
        common = common_shingles([sets[i] for i in one], [sets[i] for i in two])
        sizes = np.array([len(x) for x in sets])
        similarity = common / (sizes[one][:, None] + sizes[two][None, :] - common)
        near = (similarity >= SIMILARITY) & (roots[one][:, None] != roots[two][None, :])
        group = {r: r for r in roots.tolist()}

        def top(r: int) -> int:
            while group[r] != r:
                r = group[r]
            return r

        for i, j in zip(*(side[at].tolist() for side, at in zip((one, two), np.nonzero(near)))):
            a, b = sorted((top(roots[i]), top(roots[j])))
            if a != b:
                group[b] = a
                links.append(tuple(sorted((int(marks[i]), int(marks[j])))))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _met_in_cells(placed: DataFrame, holders: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` between members of a key with different roots; ``placed`` are ``key, mark, size, root``."""
    keys = placed.groupBy("key").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("mark")).alias("_one"), F.bit_xor(F.xxhash64("mark", F.lit(1))).alias("_two"),
        F.ceil(F.sum(F.greatest(F.col("size"), F.lit(LEAST)).cast("bigint")) / SLICE).cast("int").alias("slices"))
    keys = settle(keys.filter("_low <> _high").dropDuplicates(["n", "_one", "_two"]).select("key", "n", "slices"))
    members = join_hot(placed.select("key", F.col("mark").alias("doc_id"), "root"), keys, "key").filter("slices is not null")
    own = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("slices")).cast("int")
    dealt = members.select("key", F.col("doc_id").alias("mark"), "root", own.alias("own"),
                           F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    cell = ["key", "low", "high"]
    cells = settle(dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                                "own", "mark", "root"), "cells")
    mixed = cells.groupBy(*cell).agg(F.min("root").alias("_least"), F.max("root").alias("_most"))
    cells = settle(cells.join(mixed.filter("_least <> _most").select(*cell), cell), "cells")
    held = _sets_of(settle(cells.groupBy("mark").agg(F.count("*").alias("n"))), holders, texts)
    # join_hot slices a hot key by doc_id: here the cell
    full = join_hot(cells.withColumn("doc_id", F.xxhash64(*cell)), held, "mark").drop("doc_id")
    return settle(full.groupBy(*cell).applyInArrow(_meet, "a bigint, b bigint").distinct())


def near_groups(rows: DataFrame, texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``mark, root`` of the sets that have a near copy.

    ``rows`` as from ``_sets``, ``texts`` are ``row, text``, ``repeated`` names every ``row`` that comes again.
    """
    sets = rows.groupBy("mark").agg(F.first("size").alias("size"), F.first("finger").alias("finger"),
                                    F.first("keys").alias("keys"), F.min("row").alias("row"))
    sets = settle(sets, "keys")
    holders = settle(sets.select("mark", "row").join(repeated.withColumn("again", F.lit(True)), "row", "left")
                     .fillna(False, ["again"]))
    keyed = settle(sets.select("mark", "size", F.explode("keys").alias("key")))
    # the least member, so that the keys of one group name the same hub and its links are verified once
    hubs = keyed.groupBy("key").agg(F.min(F.struct("mark", "size")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hubs = settle(hubs.select("key", F.col("hub.mark").alias("hub"), F.col("hub.size").alias("hub_size"), "n"))
    met = settle(join_hot(keyed.withColumnRenamed("mark", "doc_id"), hubs, "key")
                 .filter("hub is not null").withColumnRenamed("doc_id", "mark"))
    stars = met.filter((F.col("mark") != F.col("hub")) & _near_in_size("size", "hub_size")).select(
        F.least("mark", "hub").alias("a"), F.greatest("mark", "hub").alias("b"))
    edges = _verified(_fingerprint_links(sets.filter("size > 0").select("mark", "finger")).unionByName(stars), holders, texts)

    # members of a key that its links did not bring together
    roots = components(edges).select(F.col("node").alias("mark"), "root")
    placed = settle(met.join(roots, "mark", "left").select("key", "mark", "size", F.coalesce("root", "mark").alias("root")))
    edges = edges.unionByName(_met_in_cells(placed, holders, texts))
    return components(edges).select(F.col("node").alias("mark"), "root")


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first of their group, columns unchanged."""
    row = F.xxhash64("doc_id", "text")
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", row.alias("row"))
    rows = settle(read.mapInArrow(
        _sets, "doc_id bigint, row bigint, mark bigint, finger bigint, size int, keys array<bigint>"), "keys")
    repeated = settle(rows.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row"))
    roots = near_groups(rows, read.select("row", "text"), repeated)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    firsts = settle(rows.groupBy("mark").agg(F.min(order).alias("first"), F.count("*").alias("n")).join(
        roots, "mark", "left").withColumn("root", F.coalesce("root", "mark")))
    best = firsts.groupBy("root").agg(F.min("first").alias("best")).select("root", F.col("best.row").alias("winner"))
    classes = settle(firsts.select("mark", "n", "root").join(best, "root").select("mark", "n", "winner"))
    judged = join_hot(rows.select(F.col("row").alias("doc_id"), "mark"), classes, "mark")
    losers = settle(judged.filter("doc_id <> winner").select(F.col("doc_id").alias("_loser")).distinct())
    left = docs.join(losers, F.xxhash64(docs["doc_id"], docs["text"]) == losers["_loser"], "left_anti").select(*docs.columns)

    # rows that share id and text, or have no id and one text, are told apart by nothing: one of them stays
    again = repeated.withColumnRenamed("row", "_again")
    if again.isEmpty():
        return left
    packed = left.select(F.xxhash64("doc_id", "text").alias("_again"), F.struct(*docs.columns).alias("whole"))
    marked = settle(packed.join(again.withColumn("_twice", F.lit(True)), "_again", "left"), "marked")
    once = marked.filter("_twice").groupBy("_again").agg(F.min("whole").alias("whole"))
    return marked.filter("_twice is null").select("whole.*").unionByName(once.select("whole.*"))

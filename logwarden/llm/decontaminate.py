"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Texts become lower-case words of letters and digits, and shingles of five words
(an item with fewer words is one shingle of its whole length). A window is as long
as the item, shorter only at the end of the document. Its similarity is that of the
shingles weighted by occurrences, sum of minima over sum of maxima.

A window is formed at every start from which it holds a shingle of its item; all other
windows have a similarity of zero. A shared shingle at a place p counts in the windows
that start from p - n + 1 to p, and where the item holds it k times only in those that
start after its k-th place before p: an interval of starts. How many intervals cover a
start is the sum of minima of its window, so a running sum over the ends of the
intervals gives it for every start, wherever the shared shingles stand.

Every window gets a 64-bit SimHash of all its shingles, weighted by occurrences, and so
does every item. Fingerprints are cut into ``RADIUS`` + 1 blocks; two within the radius
agree in at least one, so windows meet their item on equal blocks and none within the
radius is missed. Survivors of the radius are verified by their exact similarity. The
radius is wide: at a similarity of 0.8 and without repeats a bit differs with a
probability of about 0.15, and more than 31 of 64 do with one of 10^-10. Where few
shingles or repeated ones decide the votes, many bits may hang on one of them: windows
of items with fewer than ``SHORT`` shingles or with repeats are all verified,
whatever their fingerprints say.

DataFrame functions only. What leaves the first scan are places of shingles that an
item holds too; the texts of documents with windows are read once more for their
fingerprints, and only those texts can be shuffled.

Defined results: a null or empty text matches nothing, an item without words is
left out; a document may match several items, ties in similarity keep the earliest
window; repeated rows match alike and give one row; a null id is reported as null,
of documents and items; items that share an id are matched each by itself;
an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.config import Settings
from logwarden.llm.common import settle
from logwarden.operators.joins import attach

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 31
BLOCKS = RADIUS + 1  # of two bits
SHORT = 8
_LANE = 21
_LANES = 1 | 1 << _LANE | 1 << 2 * _LANE
KEYS = Settings(broadcast_rows=4_000_000)  # keys of documents with candidates: 8 bytes each, and measured
BROADCAST_SHINGLES = 300_000  # rows of about 60 bytes; a larger benchmark is joined by shuffle


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    last = F.size(words) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def simhash(shingles: Column) -> Column:
    """64 bits: each is 1 if it is set in more than half of the shingles, occurrences counted."""
    zero, lanes = F.lit(0).cast("bigint"), F.lit(_LANES)

    def moved(name: str, value: Column, by: Column) -> Column:
        return F.call_function(name, value, by)

    def voted(mark: Column, bit: Column) -> Column:
        votes = F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, bit).cast("int"))
        set_ = moved("shiftleft", F.lit(1).cast("bigint"), bit)
        return F.when(votes * 2 > F.size(shingles), mark.bitwiseOR(set_)).otherwise(mark)

    # three bits are counted in each long; what is added carries a majority to the top of its lane
    more = (F.lit(1 << (_LANE - 1)) - F.floor(F.size(shingles) / 2) - 1).cast("bigint") * lanes

    def voted_lanes(mark: Column, bit: Column) -> Column:
        votes = F.aggregate(shingles, zero, lambda n, h: n + moved("shiftrightunsigned", h, bit).bitwiseAND(lanes))
        return mark.bitwiseOR(moved("shiftleft", F.shiftrightunsigned(votes + more, _LANE - 1).bitwiseAND(lanes), bit))

    return F.when(F.size(shingles) < 1 << (_LANE - 1), F.aggregate(F.sequence(F.lit(0), F.lit(_LANE)), zero, voted_lanes)).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, voted))


def _blocks(mark: Column) -> Column:
    """The blocks of a fingerprint in order."""
    width = 64 // BLOCKS
    return F.array(*[F.shiftrightunsigned(mark, width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(BLOCKS)])


def key_of(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share an id or have none."""
    return F.xxhash64(doc_id, text)


def _hits(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Places of the shingles of ``docs`` that an item holds, with the count ``k`` in the item."""
    held = items.select("item", "item_id", "n", F.explode("shingles").alias("h")).groupBy(
        "item", "item_id", "n", "h").agg(F.count("*").cast("int").alias("k"))
    held = settle(held)
    if held.count() <= BROADCAST_SHINGLES:
        held = F.broadcast(held)
    # words stand in a column of their own: inside the lambda they would be split again for every shingle
    split = docs.select("_key", "doc_id", _words(F.col("text")).alias("_words"))
    hashed = split.select("_key", "doc_id", _shingles(F.col("_words"), size).alias("_shingles"))
    # the outer form: for the inner one a filter on the array's size would be inferred and pushed
    # below, where it repeats the split for every shingle
    places = hashed.select(
        "_key", "doc_id", F.size("_shingles").alias("length"), F.posexplode_outer("_shingles").alias("pos", "h"))
    return places.join(held, "h")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
) -> DataFrame:
    """``_key, doc_id, item_id, start, similarity`` for every document and row of the benchmark that match."""
    rows = docs.select(
        key_of(F.col(doc_id), F.col(text)).alias("_key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )
    items = benchmark.select(
        key_of(F.col(item_id), F.col(item_text)).alias("item"), F.col(item_id).alias("item_id"),
        _words(F.col(item_text)).alias("_words"))
    items = settle(items.filter(F.size("_words") > 0).distinct())
    # at most five sizes: whole shingles, and items shorter than one
    sizes = [r[0] for r in items.select(F.least(F.size("_words"), F.lit(SHINGLE)).alias("s")).distinct().collect()]
    found = [_leaks_of_size(rows, items, size, similarity) for size in sorted(sizes)]
    if not found:
        kinds = dict(rows.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
        return docs.sparkSession.createDataFrame(
            [], f"_key bigint, doc_id {kinds[0]}, item_id {kinds[1]}, start int, similarity double"
        )
    return reduce(DataFrame.unionByName, found)


def _leaks_of_size(rows: DataFrame, items: DataFrame, size: int, similarity: float) -> DataFrame:
    mine = items.filter(F.least(F.size("_words"), F.lit(SHINGLE)) == size).select(
        "item", "item_id", _shingles(F.col("_words"), size).alias("shingles"))
    mine = settle(mine.withColumn("n", F.size("shingles")))
    # repeated rows have the same places; one dealing by document and item serves all that follows
    pair = ["_key", "item"]
    alike = [*pair, "doc_id", "item_id", "n", "length"]
    runs = _hits(rows, mine, size).repartition(*pair).groupBy(*alike, "h", "k").agg(
        F.array_sort(F.collect_set("pos")).alias("at"))
    hits = settle(runs.select(*alike, "at", "k", F.posexplode("at").alias("i", "pos")))
    used_up = F.when(F.col("i") >= F.col("k"), F.get("at", F.col("i") - F.col("k")) + 1).otherwise(F.lit(0))
    low = F.greatest(F.col("pos") - F.col("n") + 1, used_up, F.lit(0))
    ends = F.array(F.struct(low.alias("start"), F.lit(1).alias("step")),
                   F.struct((F.col("pos") + 1).alias("start"), F.lit(-1).alias("step")))
    steps = hits.select(*alike, F.inline(ends)).groupBy(*alike, "start").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*pair).orderBy("start")
    counted = steps.withColumn("_both", F.sum("step").over(order)).withColumn("_next", F.lead("start").over(order))
    # between two ends the count stays
    starts = counted.filter(F.col("_both") > 0).select(
        *alike, "_both", F.explode(F.sequence("start", F.col("_next") - 1)).alias("start"))
    length = F.least(F.col("n"), F.col("length") - F.col("start"))
    placed = settle(starts.select(*pair, "doc_id", "item_id", "n", "start", length.alias("_size"), "_both"), "windows")
    near = _near_windows(rows, placed, mine, size).select(*placed.columns)
    plain = mine.filter((F.col("n") < SHORT) | (F.size(F.array_distinct("shingles")) < F.col("n"))).select("item").distinct()
    met = near.unionByName(attach(placed, plain, ["item"], how="inner"))  # a window may come twice
    scored = met.withColumn("similarity", F.col("_both") / (F.col("_size") + F.col("n") - F.col("_both")))
    best = Window.partitionBy(*pair).orderBy(F.desc("similarity"), "start")
    return (
        scored.filter(F.col("similarity") >= similarity)
        .withColumn("_best", F.row_number().over(best)).filter("_best = 1")
        .select("_key", "doc_id", "item_id", "start", "similarity")
    )


def _near_windows(rows: DataFrame, windows: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The ``windows`` whose fingerprint lies within the radius of their item's."""
    keys = windows.select("_key").distinct()
    read = attach(rows.select("_key", "text"), keys, ["_key"], how="inner", settings=KEYS)
    # rows that repeat have one key and one text
    texts = read.dropDuplicates(["_key"]).select("_key", _words(F.col("text")).alias("_words"))
    hashed = texts.select("_key", _shingles(F.col("_words"), size).alias("_shingles"))
    # one row per document, so its shingles are not copied for every window
    wanted = windows.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("start", "_size"))).alias("_wanted"))
    marks = hashed.join(wanted, "_key").select("_key", F.explode(F.transform("_wanted", lambda w: F.struct(
        w["start"].alias("start"), w["_size"].alias("_size"),
        simhash(F.slice(F.col("_shingles"), w["start"] + 1, w["_size"])).alias("mark")))).alias("w")).select("_key", "w.*")
    marked = windows.join(marks, ["_key", "start", "_size"])
    held = items.select("item", simhash(F.col("shingles")).alias("_item_mark"))
    blocks = settle(held.select("item", "_item_mark", F.posexplode(_blocks(F.col("_item_mark"))).alias("_block", "_value")), "blocks")
    cut = marked.select("*", F.posexplode(_blocks(F.col("mark"))).alias("_block", "_value"))
    near = attach(cut, blocks, ["item", "_block", "_value"], how="inner")
    equal = F.zip_with(_blocks(F.col("mark")), _blocks(F.col("_item_mark")), lambda x, y: x == y)
    # a window meets its item once, on the first block they share
    first = F.array_position(equal, True) - 1
    return near.filter(F.col("_block") == first).filter(
        F.bit_count(F.col("mark").bitwiseXOR(F.col("_item_mark"))) <= RADIUS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, columns unchanged."""
    leaks = settle(find_leaks(docs, benchmark).select(F.col("_key").alias("_leak")).distinct())
    return docs.join(leaks, key_of(docs["doc_id"], docs["text"]) == leaks["_leak"], "left_anti").select(*docs.columns)

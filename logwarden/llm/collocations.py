"""Phrase collocations by Toivonen's sampling (VLDB 1996), exact over all documents.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words
``[^\\x20\\x09]+``; everything is counted per language. A phrase of up to ``LONGEST``
words is frequent if it occurs ``least`` times or more.

A sample of the documents proposes phrases, level by level, at a lowered count. The
full pass counts, over all documents, the proposed phrases and their negative border:
every phrase that is not proposed but whose parts (without its first, without its
last word) are; all words belong to it. Only 64-bit hashes are sent, so a count can be
too high where two phrases share a hash, never too low. What reaches ``least`` may be
frequent, and a border phrase among it is a failure of the sample: longer phrases on
top of it have not been counted. So an expansion pass goes over all documents again. It
counts by their words the phrases that may be frequent, and with them every phrase that
is reached through a failure, however long. After it the border is closed: a frequent
phrase has frequent parts, so it was counted by one pass or the other.

Sets of phrases travel as Bloom filters of a fixed size (``BITS``), never as sets that
grow with the corpus. A false positive only counts a phrase that needed no count. Tasks
count groups of whole documents with numpy and send one row for each different phrase
of a group; Spark sums them.

Scores, containment and ranks are DataFrame functions on the frequent phrases only.

Defined results: a null text is empty, a null language is ``und``; texts without words
give nothing; repeated rows count as often as they stand; ties follow the stated order,
so a rank is unique; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import settle
from logwarden.operators.joins import attach

LEAST = 30
LONGEST = 4
TOP = 2_000
SCALE = 2_000_000
COVERED_PERCENT = 80
SAMPLE_PARTS = 4  # one part of the documents proposes phrases
SAMPLE_LEAST = 3  # LEAST / SAMPLE_PARTS is 7.5: a phrase at LEAST is missed by 2 % of samples
BITS = 1 << 26  # of the Bloom filter, 8 MB
PROBES = 3
GROUP_CHARS = 8_000_000
RANK_SLICES = 256
_MANY = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(marks: np.ndarray) -> Iterator[np.ndarray]:
    """Bit numbers of phrase hashes."""
    step = _mixed(marks ^ _MANY) | np.uint64(1)
    for probe in range(PROBES):
        yield (marks + np.uint64(probe) * step) & np.uint64(BITS - 1)


def _holds(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    found = np.ones(len(marks), bool)
    for place in _places(marks):
        found &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def no_phrases() -> np.ndarray:
    return np.zeros(BITS // 64, np.uint64)


def filter_of(marks: DataFrame) -> np.ndarray:
    """Bloom filter of the hashes ``h``. What reaches the driver is at most the filter itself, bit words and places."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            place = np.concatenate([*_places(hashes)])
            bit = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(bit.view(np.int64))], ["word", "bit"])

    words = marks.select("h").mapInArrow(probes, "word int, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits, found = no_phrases(), words.toArrow()
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


@dataclass
class Level:
    """The different phrases of one length in a group of documents of one language."""

    at: np.ndarray  # phrase that begins at each place, -1 for none
    count: np.ndarray
    marks: np.ndarray  # hashes
    last: np.ndarray  # last word
    front: np.ndarray  # phrase of the level below without the last word
    proposed: np.ndarray  # counted in the full pass, and proposed by the sample
    passes: np.ndarray  # longer phrases on top of it are reached


def split_words(texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
    """Word numbers of all texts in order, -1 between pieces, and the words."""
    data = b"\n".join(texts).translate(_LOWER).replace(b"\n", b" \n ") + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).astype(np.int64) + 1
    offsets = np.concatenate([[0], ends])
    cells = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = cells.dictionary_encode()
    words = coded.dictionary.to_pylist()  # each with the blank that ends it
    numbers, order, kept = np.full(len(words), -2, np.int32), 0, []
    for i, word in enumerate(words):
        if word == b"\n ":
            numbers[i] = -1
        elif word != b" ":
            numbers[i], order = order, order + 1
            kept.append(word[:-1].decode())
    at = numbers[coded.indices.to_numpy()]
    return at[at != -2], kept


def levels(
    at: np.ndarray, words: list[str], lang: str, proposed: np.ndarray, often: np.ndarray | None = None, longest: int = LONGEST
) -> list[Level]:
    """The reached phrases of every length.

    A phrase is reached if both its parts pass: in the full pass what is proposed, in the
    expansion pass (with ``often``) what may be frequent or was not counted before.
    """
    size = len(words)
    seed = xxhash.xxh64_intdigest(lang)
    marks = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)

    def level(place: np.ndarray, count: np.ndarray, marks: np.ndarray, last: np.ndarray, front: np.ndarray, counted: np.ndarray) -> Level:
        known = counted & _holds(proposed, marks)
        return Level(place, count, marks, last, front, known, known if often is None else ~counted | _holds(often, marks))

    one = level(at, np.bincount(at[at >= 0], minlength=size), marks, np.arange(size), np.zeros(size, np.int64), np.ones(size, bool))
    found = [one]
    while len(found) < longest:
        below = found[-1]
        here, ahead = below.at[:-1], below.at[1:]
        if not len(here):
            break
        passes = np.append(below.passes, False)  # -1 finds the last
        meets = passes[here] & passes[ahead]
        codes, kinds = pd.factorize(here[meets].astype(np.int64) * size + at[len(found) :][meets])
        suffix = np.zeros(len(kinds), np.int32)
        suffix[codes] = ahead[meets]
        front, last = kinds // max(size, 1), kinds % max(size, 1)
        place = np.full(len(here), -1, np.int32)
        place[meets] = codes
        found.append(level(place, np.bincount(codes, minlength=len(kinds)), _mixed(below.marks[front] * _MANY + one.marks[last]),
                           last, front, below.proposed[front] & below.proposed[suffix]))
    return found


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, of about ``GROUP_CHARS`` bytes together unless a single one is longer."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                total += len(text)
                if total >= GROUP_CHARS:
                    yield from held.items()
                    held, total = {}, 0
    yield from held.items()


def _phrases(found: list[Level], words: pa.Array, level: int, chosen: np.ndarray) -> pa.Array:
    """The chosen phrases of a level as strings."""
    parts, at = [], chosen
    for k in range(level, 0, -1):
        parts.append(words.take(pa.array(found[k].last[at])))
        at = found[k].front[at]
    parts.append(words.take(pa.array(at)))
    return pc.binary_join_element_wise(*reversed(parts), pa.scalar(" ", words.type))


COUNTED = "lang string, k int, phrase string, n bigint"


def count_phrases(docs: DataFrame, proposed: Broadcast, often: Broadcast) -> DataFrame:
    """The expansion pass: ``COUNTED`` rows of every group; ``k`` 0 holds all its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in COUNTED.split(", ")]
        for lang, texts in _groups(batches):
            at, strings = split_words(texts)
            if not strings:
                continue
            found = levels(at, strings, lang, proposed.value, often.value)
            words = pa.array(strings, pa.large_string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int(found[0].count.sum())])], names)
            for k, level in enumerate(found):
                chosen = np.flatnonzero(level.passes)
                for start in range(0, len(chosen), 200_000):
                    part = chosen[start : start + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]).take(pa.array(np.zeros(len(part), np.int8))), pa.array(np.full(len(part), k + 1, np.int32)),
                         _phrases(found, words, k, part).cast(pa.string()), pa.array(level.count[part].astype(np.int64))], names)

    return docs.mapInArrow(count, COUNTED)


def frequent_marks(docs: DataFrame, proposed: Broadcast, least: int, only: int | None = None) -> DataFrame:
    """Hashes ``h`` of proposed phrases and their border that may occur ``least`` times; ``only`` those of so many words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _groups(batches):
            at, strings = split_words(texts)
            found = levels(at, strings, lang, proposed.value, longest=only or LONGEST) if strings else []
            for level in found if only is None else found[only - 1 :]:
                for start in range(0, len(level.marks), 500_000):
                    part = slice(start, start + 500_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(level.marks[part].view(np.int64)), pa.array(level.count[part].astype(np.int32))], ["h", "n"])

    counted = docs.mapInArrow(count, "h bigint, n int")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h")


def propose(spark: SparkSession, sample: DataFrame, least: int = SAMPLE_LEAST) -> np.ndarray:
    """Filter of the phrases, up to one word shorter than the longest, that are frequent in the sample."""
    bits = no_phrases()
    for level in range(1, LONGEST):
        sent = spark.sparkContext.broadcast(bits)
        bits = bits | filter_of(frequent_marks(sample, sent, least, only=level))
        sent.destroy()
    return bits


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    least: int = LEAST, sample_least: int = SAMPLE_LEAST,
) -> DataFrame:
    """``lang, k, phrase, n`` of all phrases that occur ``least`` times; ``k`` 0 holds the words of a language.

    The id, where there is one, only keeps copies of a text from coming into the sample all together.
    """
    spark = docs.sparkSession
    named = F.col(doc_id) if doc_id in docs.columns else F.lit(0)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), named.alias("id"))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE_PARTS))
    proposed = spark.sparkContext.broadcast(
        propose(spark, settle(rows.filter(part == 0).select("lang", "text"), "sample"), sample_least))
    rows = rows.select("lang", "text")
    often = spark.sparkContext.broadcast(filter_of(frequent_marks(rows, proposed, least)))
    sums = count_phrases(rows, proposed, often).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    found = settle(sums.filter((F.col("n") >= least) | (F.col("k") == 0)), "phrases")
    proposed.destroy()
    often.destroy()
    return found


def _with_counts(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """Add the count of the phrase in column ``part``; a part of very many phrases is cut into slices."""
    used = cuts.groupBy("lang", part).agg(F.count("*").alias("_uses"))
    sides = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)).join(used, ["lang", part])
    return attach(cuts, sides, ["lang", part], how="inner", rows="_uses", salt_on="phrase")


def score_phrases(found: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of every candidate that no longer one covers."""
    counts = found.filter("k > 0")
    phrases = counts.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    both = _with_counts(_with_counts(settle(cuts), counts, "first", "l"), counts, "rest", "r")
    # 38 digits: the product may pass 64 bits
    score = F.expr(f"cast(cast({SCALE} as decimal(18, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r) as bigint)")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    scored = lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")

    spans = F.array(*[F.struct(F.lit(start).alias("start"), F.lit(size).alias("size"))
                      for size in range(2, LONGEST) for start in range(1, LONGEST - size + 2)])
    inner = phrases.filter("k > 2").select("lang", "k", "a", "w", F.inline(spans)).filter("size < k and start + size - 1 <= k")
    covers = inner.select("lang", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("_most"))
    return scored.join(covers, ["lang", "phrase"], "left").filter(
        F.coalesce(F.lit(100) * F.col("_most") < F.lit(COVERED_PERCENT) * F.col("a"), F.lit(True))).drop("_most")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", top: int = TOP,
    least: int = LEAST, sample_least: int = SAMPLE_LEAST,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    found = frequent_phrases(docs, text, lang, doc_id, least, sample_least)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language may hold most phrases: slices keep their first rows, so the last sort has top * RANK_SLICES rows at most
    sliced = score_phrases(found).withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES)))
    best = sliced.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("_at") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    totals = found.filter("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

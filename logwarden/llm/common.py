"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.session import ensure_checkpoint_dir

# ASCII white space; words are what stands between
SPACE = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_TOOLS: list = []


def worker_tool(build: Callable) -> Callable:
    """Cache what ``build`` makes for the tasks a Python worker runs one after the other."""
    cached = lru_cache(maxsize=2)(build)
    _TOOLS.append(cached)
    return cached


def drop_tools() -> None:
    """Free the tools that other operators left in this worker; they are built again when asked for."""
    for tool in _TOOLS:
        tool.cache_clear()


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of a job as soon as its result is written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` to the shared folder and read that instead, so that lost executors cost single tasks."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def text_groups(texts: list[str | None], rows: int = 10_000, chars: int = 10_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that a task handles together, bounded in rows and characters."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= rows or size > chars):
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if texts:
        yield start, len(texts)


def batch_groups(batch: pa.RecordBatch, at: int = 1, rows: int = 2_000, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` bounded in rows and in bytes of the texts in column ``at``; a longer text is alone."""
    ends = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


class WordTable:
    """Results per distinct word, computed for many words at once.

    Words that came more than once in a group are kept for later groups until the
    table is full; the long tail of rare words is held for its own group only.
    """

    def __init__(self, learn: Callable[[list[str]], dict[str, bytes]], limit: int) -> None:
        self.learn, self.limit = learn, limit
        self.kept: dict[str, bytes] = {}

    def lookup(self, groups: Iterable[list[str]]) -> dict[str, bytes]:
        """Results of all words in ``groups``."""
        counts = Counter(chain.from_iterable(groups))
        kept = self.kept
        found = {w: kept[w] for w in counts.keys() & kept.keys()} if kept else {}
        fresh = self.learn([w for w in counts if w not in found])
        room = self.limit - len(kept)
        if room > 0:
            often = [w for w in fresh if counts[w] > 1]
            kept.update((w, fresh[w]) for w in often[:room])
        found.update(fresh)
        return found

"""Time slices with a margin, so that a busy key is spread over many tasks.

A span rule looks at most a fixed time back and ahead. Rows are first reduced to
one row per (key, second); a key is then cut into slices of fixed length, and
rows near a slice border are copied to the neighbour as context. A slice holds
at most (length + margins) seconds of rows however many lines the key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions.numbers import HOUR

SLICE = "_slice"
AT = "_at"


def sliced(df: DataFrame, back: int, ahead: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Copy each row to every slice that needs it; ``_at`` holds microseconds.

    ``back`` and ``ahead`` say how far a slice looks beyond its own borders.
    """
    width = settings.chunk_hours * HOUR
    first = F.floor((F.col(AT) - ahead) / width).cast("bigint")
    last = F.floor((F.col(AT) + back) / width).cast("bigint")
    return df.withColumn(SLICE, F.explode(F.sequence(first, last)))


def own_slice(settings: Settings = DEFAULTS) -> Column:
    width = settings.chunk_hours * HOUR
    return F.col(SLICE) == F.floor(F.col(AT) / width).cast("bigint")


def by_time(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(AT, *order)

"""Consecutive numbers over a global order without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.session import settle

_SLOT = "_slot"


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str,
    start: int = 1,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add ``name`` = position of the row in ``order``, counted from ``start``.

    The rows are range-sorted once and settled, so that positions inside the
    sorted partitions are final; the number of rows per partition gives each
    partition its offset. Equal keys do not hurt as long as ``order`` ends in a
    unique column. ``within`` restarts the count for every value of a few
    columns that have few distinct values (runs of an evaluation).
    """
    within = list(within)
    sorted_rows = df.orderBy(*within, *order).withColumn(_SLOT, F.monotonically_increasing_id())
    slots = settle(sorted_rows)
    partition = F.shiftrightunsigned(_SLOT, 33)
    inside = F.col(_SLOT).bitwiseAND(F.lit((1 << 33) - 1))

    # one row per sorted partition: the window and the broadcast are bounded by that
    sizes = slots.groupBy(partition.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = (
        slots.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside)
        .drop("_part", "_offset", _SLOT)
    )
    if within:
        first = placed.groupBy(*within).agg(F.min(name).alias("_first"))
        placed = (
            placed.join(F.broadcast(first), within)
            .withColumn(name, F.col(name) - F.col("_first"))
            .drop("_first")
        )
    return placed.withColumn(name, F.col(name) + start)

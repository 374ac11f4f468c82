"""Ranks over a global order, peers included, without a window over all rows.

Equal values are counted first. The distinct values are range-sorted and settled;
totals of whole sorted partitions and a running total inside each give every value
the number of rows and of values before it. Ranks return to the rows by value, and
a value that very many rows hold is cut into slices on the way.

Defined results: missing values are peers of each other and come first; NaN comes
last; the percent rank of a single row is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.operators.joins import attach
from logwarden.operators.ordering import number_rows
from logwarden.session import settle

RANKS = ("rank", "dense_rank", "percent_rank", "cume_dist")


def rank_rows(df: DataFrame, order: Sequence[str], salt_on: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``rank, dense_rank, percent_rank, cume_dist`` by the columns ``order``; ``salt_on`` differs between peers."""
    if clash := set(RANKS) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    value = F.struct(*order)  # a struct with a missing field equals itself, a missing value does not
    peers = df.groupBy(value.alias("_value")).agg(F.count("*").alias("_peers"))
    slots = settle(peers.orderBy("_value").withColumn("_slot", F.monotonically_increasing_id()))
    slots = slots.withColumn("_part", F.shiftrightunsigned("_slot", 33))

    # one row per sorted partition
    parts = slots.groupBy("_part").agg(F.sum("_peers").alias("_rows"), F.count("*").alias("_values"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_values")])
    total = F.broadcast(parts.agg(F.sum("_rows").alias("_total")))
    inside = Window.partitionBy("_part").orderBy("_slot")
    run = F.sum("_peers").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    upto = slots.withColumn("_run", run).withColumn("_nth", F.row_number().over(inside)).join(F.broadcast(offsets), "_part")
    last = F.col("_rows_before") + F.col("_run")
    ranked = upto.crossJoin(total).select(  # one row with the number of all rows
        "_value", "_peers",
        (last - F.col("_peers") + 1).alias("rank"),
        (F.col("_values_before") + F.col("_nth")).alias("dense_rank"),
        F.when(F.col("_total") > 1, (last - F.col("_peers")) / (F.col("_total") - 1)).otherwise(0.0).alias("percent_rank"),
        (last / F.col("_total")).alias("cume_dist"),
    )
    keyed = df.withColumn("_value", value)
    return attach(keyed, ranked, ["_value"], how="inner", rows="_peers", salt_on=salt_on, settings=settings).drop("_value")


def tile_rows(df: DataFrame, order: Sequence[str], tiles: int, name: str = "ntile") -> DataFrame:
    """Add the number of the tile among ``tiles`` of equal size, larger ones first; ``order`` ends in a unique column."""
    numbered = settle(number_rows(df, order, "_at", start=0))
    total = numbered.count()
    size, extra = divmod(total, tiles)
    wide = extra * (size + 1)  # rows in the tiles that hold one more
    at = F.col("_at")
    late = F.floor((at - wide) / max(size, 1)) + extra
    return numbered.withColumn(name, F.when(at < wide, F.floor(at / (size + 1))).otherwise(late).cast("int") + 1).drop("_at")

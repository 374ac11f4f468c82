"""Exact weighted quantiles per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.session import settle


def weighted_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    weight: Column,
    shares: Sequence[float],
    bin_of: Column,
) -> DataFrame:
    """``(by..., share, quantile)`` with linear interpolation between ranks.

    The same as sorting every value ``weight`` times over and reading position
    ``share * (n - 1)``. Equal values are summed first. ``bin_of`` maps a value to
    an ordered bin: counts per bin tell which bins hold the wanted ranks, and
    only the values of those bins are sorted.
    """
    by = list(by)
    values = settle(
        df.select(*by, F.col(value).cast("double").alias("_v"), bin_of.cast("bigint").alias("_bin"),
                  weight.cast("bigint").alias("_w"))
        .groupBy(*by, "_bin", "_v").agg(F.sum("_w").alias("_w"))
    )
    bins = values.groupBy(*by, "_bin").agg(F.sum("_w").alias("_w"))
    group = Window.partitionBy(*by)
    counted = bins.withColumn("_upto", F.sum("_w").over(group.orderBy("_bin"))).withColumn(
        "_n", F.sum("_w").over(group)
    )
    shares_col = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    wanted = (
        counted.withColumn("share", shares_col)
        .withColumn("_pos", F.col("share") * (F.col("_n") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_w")))
        .select(*by, "share", "_pos", "_rank", "_bin", (F.col("_upto") - F.col("_w")).alias("_before"))
    )
    inside = Window.partitionBy(*by, "share", "_rank").orderBy("_v")
    found = (
        wanted.join(values, [*by, "_bin"])
        .withColumn("_end", F.col("_before") + F.sum("_w").over(inside))
        .filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_w")))
    )
    part = F.first("_pos") - F.min("_rank")
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    return found.groupBy(*by, "share").agg((low + (high - low) * part).alias("quantile"))

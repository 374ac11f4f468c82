"""As-of join: every row of one table meets the nearest row of another in time.

Both sides are first reduced to one row per (key, instant) and dealt to slices of
fixed length. Inside a slice a running last value finds the partner; what happened
before a slice arrives as a carry: one row per slice holds its last partner, and a
prefix over these rows hands it on. So no margin has to cover the longest silence,
and a key with a third of all rows is spread over its slices.

Defined results: rows without key or time keep their place and meet nothing; among
partners of one instant the last in ``order`` is met, looking forward the first;
partners of the same instant count in every direction; of two equally near ones the
one before is met. Empty tables on either side work. A left column that has the
name of a result column is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions.numbers import HOUR, micros
from logwarden.operators.joins import attach
from logwarden.session import settle

DIRECTIONS = ("backward", "forward", "nearest")


def _complete(by: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, "_at"]])


def _running(instants: DataFrame, right: DataFrame, by: list[str], sign: int, width: int) -> DataFrame:
    """``by, _at, _met``: for each instant the last partner up to it, where time runs along ``sign``."""
    partner = F.struct((F.col("_at") * sign).alias("_at"), "_value")
    # the last partner of an instant along the direction of time
    reduced = right.groupBy(*by, "_at").agg((F.max if sign > 0 else F.min)(F.struct("_order", "_value")).alias("_best"))
    reduced = reduced.select(*by, "_at", F.col("_best._value").alias("_value"))
    met = reduced.select(*by, (F.col("_at") * sign).alias("_at"), F.lit(False).alias("_asks"), partner.alias("_met"))
    asks = instants.select(
        *by, (F.col("_at") * sign).alias("_at"), F.lit(True).alias("_asks"), F.lit(None).cast(met.schema["_met"].dataType).alias("_met"))
    rows = asks.unionByName(met).withColumn("_slice", F.floor(F.col("_at") / width).cast("bigint"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_met", F.last("_met", ignorenulls=True).over(inside)).filter("_asks")

    # one row per (key, slice): the prefix is bounded by the length of the log, not by its rows
    ends = rows.groupBy(*by, "_slice").agg(F.max_by("_met", F.when(~F.col("_asks"), F.col("_at"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    return found.join(carried, [*by, "_slice"]).select(
        *by, (F.col("_at") * sign).alias("_at"), F.coalesce("_met", "_carry").alias("_met"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    time: str = "timestamp",
    order: Sequence[str] = (),
    direction: str = "backward",
    tolerance: int | None = None,
    prefix: str = "met_",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add ``prefix + value`` for each of ``values`` of the partner in ``right``.

    ``order`` breaks ties inside an instant; ``tolerance`` is the longest distance in
    microseconds, itself included.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    if not by:
        raise ValueError("an as-of join needs a key")
    if clash := {prefix + v for v in values} & set(left.columns):
        raise ValueError(f"the left side has columns {sorted(clash)} already")
    by, width = list(by), settings.chunk_hours * HOUR
    # the rows travel as one struct, so no column of theirs meets a helper's name
    asked = left.select(F.struct(*left.columns).alias("_row"), *by, micros(F.col(time)).alias("_at"))
    instants = asked.filter(_complete(by)).groupBy(*by, "_at").agg(F.count("*").alias("_rows"))
    partners = right.select(
        *by, micros(F.col(time)).alias("_at"), F.struct(F.lit(0), *order).alias("_order"), F.struct(*values).alias("_value"),
    ).filter(_complete(by))
    if direction == "nearest":
        instants, partners = settle(instants), settle(partners)

    sides = {"backward": [1], "forward": [-1], "nearest": [1, -1]}[direction]
    met = []
    for sign in sides:
        away = F.col("_at") * sign - F.col("_met._at")
        near = F.col("_met").isNotNull() if tolerance is None else away <= tolerance
        met.append(_running(instants.drop("_rows"), partners, by, sign, width).select(
            *by, "_at", F.when(near, F.struct(away.alias("away"), F.lit(-sign).alias("side"), F.col("_met._value").alias("value"))).alias("_met")))
    if direction == "nearest":
        both = met[0].join(met[1].withColumnRenamed("_met", "_next"), [*by, "_at"])
        earlier = F.col("_next").isNull() | (F.col("_met.away") <= F.col("_next.away"))
        met = [both.select(*by, "_at", F.when(F.col("_met").isNotNull() & earlier, F.col("_met")).otherwise(F.col("_next")).alias("_met"))]
    found = met[0].filter("_met is not null").join(instants, [*by, "_at"])
    joined = attach(asked, found, [*by, "_at"], rows="_rows", salt_on="_row", settings=settings)
    return joined.select("_row.*", *[F.col("_met.value")[v].alias(prefix + v) for v in values])

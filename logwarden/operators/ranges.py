"""Range join: all pairs of intervals that overlap, without a cross join.

Intervals are closed and may be points. Each is at home on the level whose bins are
longer than itself, so it touches two bins there at most, however long it is. A pair
meets on the higher of its two levels and is given out in the first bin both touch
there. A row visits its own level and those higher ones that the other side is at
home on, sixty at most.

A bin in which many meet many is cut into a grid: every row of one side is dealt to
a line of cells, every row of the other to a column, so each pair meets in exactly
one cell and no task receives a bin whole.

Defined results: rows with a missing bound or key, or an end before its start, meet
nothing; repeated rows give repeated pairs; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions.numbers import MINUTE, micros
from logwarden.operators.joins import attach
from logwarden.session import settle

WIDTH = 10 * MINUTE  # bins of the lowest level, in microseconds


def _placed(df: DataFrame, by: list[str], span: tuple[str, str], width: int) -> DataFrame:
    """``by``, the whole row as one column, its bounds as integers and the level it is at home on."""
    low, high = (micros(F.col(c)).alias(n) for c, n in zip(span, ("_from", "_to")))
    rows = df.select(*by, F.struct(*df.columns).alias("_row"), low, high)
    good = reduce(Column.__and__, [F.col(c).isNotNull() for c in by], F.col("_from") <= F.col("_to"))
    widths = F.floor((F.col("_to") - F.col("_from")) / width).cast("bigint")
    level = F.when(widths == 0, 0).otherwise(F.char_length(F.bin(widths)))
    return settle(rows.filter(good).withColumn("_home", level.cast("int")))


def _homes(rows: DataFrame) -> list[int]:
    """Levels that are in use: sixty numbers at most."""
    return [r[0] for r in rows.select("_home").distinct().collect()]


def _in_bins(rows: DataFrame, others: list[int], width: int) -> DataFrame:
    higher = F.filter(F.lit(others).cast("array<int>"), lambda v: v > F.col("_home"))
    at = rows.withColumn("_level", F.explode(F.concat(F.array("_home"), higher)))
    size = F.pow(F.lit(2.0), F.col("_level")).cast("bigint") * width
    first, last = (F.floor(F.col(c) / size).cast("bigint") for c in ("_from", "_to"))
    return at.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    by: Sequence[str] = (),
    width: int = WIDTH,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``left, right``: both rows as structs, for every overlapping pair with equal ``by``."""
    by = list(by)
    one, two = _placed(left, by, left_span, width), _placed(right, by, right_span, width)
    one, two = _in_bins(one, _homes(two), width), _in_bins(two, _homes(one), width)

    # bins in which either side is heavy and the other has rows at all
    bin_of = [*by, "_level", "_bin"]
    counts = one.groupBy(*bin_of).agg(F.count("*").alias("_n1")).join(
        two.groupBy(*bin_of).agg(F.count("*").alias("_n2")), bin_of)
    most = settings.heavy_key_rows
    grid = settle(counts.filter((F.col("_n1") > most) | (F.col("_n2") > most)).select(
        *bin_of, *[F.ceil(F.col(n) / most).cast("bigint").alias(g) for n, g in (("_n1", "_lines"), ("_n2", "_columns"))],
        *[F.col(n).alias(n) for n in ("_n1", "_n2")]))

    def dealt(rows: DataFrame, n: str, own: str, cell: str, copies: str, other: str) -> DataFrame:
        table = grid.select(*bin_of, "_lines", "_columns", n)
        cut = attach(rows, table, bin_of, rows=n, salt_on="_row", settings=settings)
        mine = F.pmod(F.xxhash64("_row"), F.coalesce(own, F.lit(1)))
        every = F.sequence(F.lit(0).cast("bigint"), F.coalesce(copies, F.lit(1)) - 1)
        return cut.withColumn(cell, mine).withColumn(other, F.explode(every)).drop("_lines", "_columns")

    one = dealt(one, "_n1", "_lines", "_line", "_columns", "_column")
    two = dealt(two, "_n2", "_columns", "_column", "_lines", "_line")
    names = ("_row", "_from", "_to", "_home", "_first")
    on = [*bin_of, "_line", "_column"]
    a = one.select(*on, *[F.col(c).alias(f"a{c}") for c in names])
    b = two.select(*on, *[F.col(c).alias(f"b{c}") for c in names])
    met = a.join(b, on).filter(
        (F.greatest("a_home", "b_home") == F.col("_level"))
        & (F.greatest("a_first", "b_first") == F.col("_bin"))
        & (F.col("a_from") <= F.col("b_to")) & (F.col("b_from") <= F.col("a_to")))
    return met.select(F.col("a_row").alias("left"), F.col("b_row").alias("right"))

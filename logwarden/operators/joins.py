"""Joins whose strategy is decided by measured sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.session import settle

_SALT = "_salt"


def written_bytes(table: DataFrame) -> int:
    """Size of the files behind a settled table, which bounds what a broadcast of it moves."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def attach(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    rows: str | None = None,
    salt_on: str = "line_number",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Join ``right`` (one row per key) to the much larger ``left``.

    ``right`` is computed once, counted and measured. Up to ``broadcast_rows`` rows
    and ``broadcast_bytes`` bytes it is broadcast and ``left`` is not shuffled at all.
    Above that both sides are
    shuffled; when ``rows`` names the column of ``right`` holding how many left
    rows carry the key, each heavy key is cut into slices by ``salt_on`` so that
    no task receives one key whole. The table of heavy keys holds at most
    (rows of left / heavy_key_rows) entries and is itself checked before it is
    broadcast.
    """
    on = list(on)
    right = settle(right)
    if written_bytes(right) <= settings.broadcast_bytes and right.count() <= settings.broadcast_rows:
        kept = right.drop(rows) if rows else right
        return left.join(F.broadcast(kept), on, how)
    if rows is None:
        return left.join(right, on, how)

    slices = F.ceil(F.col(rows) / settings.heavy_key_rows).cast("bigint")
    heavy = right.filter(F.col(rows) > settings.heavy_key_rows).select(*on, slices.alias("_slices"))
    n_heavy = heavy.count()
    if n_heavy == 0:
        return left.join(right.drop(rows), on, how)
    if n_heavy <= settings.broadcast_rows:
        heavy = F.broadcast(heavy)
    spread = left.join(heavy, on, "left").withColumn(
        _SALT, F.pmod(F.xxhash64(salt_on), F.coalesce("_slices", F.lit(1)))
    )
    copies = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(slices, F.lit(1)) - 1)))
    joined = spread.drop("_slices").join(copies.drop(rows), [*on, _SALT], how)
    return joined.drop(_SALT)


def join_totals(left: DataFrame, totals: DataFrame, run: Sequence[str]) -> DataFrame:
    """Give every row the totals of its run; ``totals`` has a few rows per run.

    Without runs the few rows become constants of the plan.
    """
    if run:
        return left.join(F.broadcast(totals), list(run))
    fields = totals.schema.fields
    rows = [
        F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for row in totals.collect()
    ]
    kind = totals.schema.simpleString()
    each = F.explode(F.array(*rows) if rows else F.array().cast(f"array<{kind}>"))
    return left.withColumn("_totals", each).select(*left.columns, "_totals.*")

"""Numeric helpers: event time as an integer, rates, reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE


def micros(ts: Column) -> Column:
    """Wall-clock microseconds since 1970, independent of the session time zone."""
    days = F.unix_date(ts.cast("date")).cast("bigint") * (24 * HOUR)
    clock = F.hour(ts).cast("bigint") * HOUR + F.minute(ts).cast("bigint") * MINUTE
    seconds = (F.date_part(F.lit("SECOND"), ts) * SECOND).cast("bigint")
    return days + clock + seconds


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, or 0.0 when the denominator is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def round3(value: Column) -> Column:
    """Three decimals, half to even."""
    return F.bround(value, 3)


def draw(n: int | Column, *parts: Column | str | int) -> Column:
    """A draw from ``0 .. n-1`` decided only by ``parts``.

    No generator state is carried, so a draw is the same under any partitioning,
    and any engine that has md5 can repeat it.
    """
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, n if isinstance(n, Column) else F.lit(n))


def draw_between(low: int, high: int, *parts: Column | str | int) -> Column:
    return F.lit(low) + draw(high - low + 1, *parts)


def pick(values: list[str], *parts: Column | str | int) -> Column:
    """One of ``values``, drawn."""
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (draw(len(values), *parts) + 1).cast("int"))

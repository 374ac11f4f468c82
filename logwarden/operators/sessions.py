"""Sessions of a key: rows that follow each other no later than the gap of an earlier one.

Every row has a gap of its own. A session lasts from its first row to the latest end
(time plus gap) of its rows, itself included; a row that comes after that end opens the next.

The batch form does not use one window per key: rows become one row per (key,
instant), these are dealt to slices of fixed length, and the reach of all earlier
slices arrives as a prefix over one row per slice. So a key with a third of all rows
is spread over its slices. ``stream_sessions`` is the same over a stream, with the
session window and its mergeable state.

Defined results: rows without key or time, or whose gap is missing or not above
zero, belong to no session; an empty table has no sessions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions.numbers import HOUR, micros


def _complete(events: DataFrame, by: Sequence[str], gap: Column, time: str) -> DataFrame:
    rows = events.select(*by, F.col(time).alias("_time"), gap.cast("bigint").alias("_gap"))
    return rows.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, "_time"]], F.col("_gap") > 0))


def gap_sessions(
    events: DataFrame, by: Sequence[str], gap: Column, time: str = "timestamp", settings: Settings = DEFAULTS
) -> DataFrame:
    """``by, session_start, session_end, events``; ``gap`` counts seconds."""
    by, width = list(by), settings.chunk_hours * HOUR
    rows = _complete(events, by, gap, time)
    instants = rows.groupBy(*by, "_time").agg(F.max("_gap").alias("_gap"), F.count("*").alias("_rows"))
    until = F.col("_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_gap"))
    instants = instants.withColumn("_until", until).withColumn("_slice", F.floor(micros(F.col("_time")) / width).cast("bigint"))

    ordered = Window.partitionBy(*by, "_slice").orderBy("_time")
    earlier, upto = (ordered.rowsBetween(Window.unboundedPreceding, to) for to in (-1, 0))
    slices = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (key, slice): the prefixes are bounded by the length of the log, not by its rows
    reach = instants.groupBy(*by, "_slice").agg(F.max("_until").alias("_last")).select(
        *by, "_slice", F.max("_last").over(slices).alias("_reach"))
    before = F.greatest(F.max("_until").over(earlier), F.col("_reach"))
    opened = (
        instants.join(reach, [*by, "_slice"])
        .withColumn("_before", before)
        .withColumn("_opens", F.when(F.col("_before").isNull() | (F.col("_time") > F.col("_before")), F.col("_time")))
    )
    opens = opened.groupBy(*by, "_slice").agg(F.max("_opens").alias("_last")).select(
        *by, "_slice", F.max("_last").over(slices).alias("_open"))
    named = opened.withColumn("_here", F.max("_opens").over(upto)).join(opens, [*by, "_slice"])
    return named.groupBy(*by, F.coalesce("_here", "_open").alias("session_start")).agg(
        F.max("_until").alias("session_end"), F.sum("_rows").alias("events"))


def _clock(instant: Column) -> Column:
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def stream_sessions(
    events: DataFrame, by: Sequence[str], gap: Column, delay: str, time: str = "timestamp"
) -> DataFrame:
    """The sessions of a stream; one is given out when the watermark, ``delay`` behind, has passed its end."""
    # watermarks want an instant: the wall clock stands for one in UTC, whatever the session's time zone
    rows = _complete(events, by, gap, time).withColumn("_time", F.timestamp_micros(micros(F.col("_time")))).withWatermark("_time", delay)
    window = F.session_window("_time", F.concat(F.col("_gap").cast("string"), F.lit(" seconds")))
    found = rows.groupBy(*by, window.alias("_session")).agg(F.count("*").alias("events"))
    return found.select(
        *by, _clock(F.col("_session.start")).alias("session_start"), _clock(F.col("_session.end")).alias("session_end"), "events")

"""Impossible travel: two near logins of one user from different networks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions import text
from logwarden.functions.numbers import MINUTE, micros
from logwarden.operators.joins import attach
from logwarden.operators.spans import AT, SLICE, by_time, own_slice, sliced


def travel_lines(events: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """Line numbers of logins whose previous login came from another network.

    Order of logins is (time, line). Inside one second the previous login is
    found among lines of the same slice of line numbers; across seconds only the
    last login of the second (or slice) before matters, so the wider window sees
    one row per (user, second, slice).
    """
    run = list(run)
    window = settings.travel_window_minutes * MINUTE
    logins = events.filter(
        text.is_accepted_login(F.col("message"))
        & F.col("source_ip").isNotNull()
        & F.col("timestamp").isNotNull()
        & F.col("user").isNotNull()
    ).select(
        *run, "user", "line_number", micros(F.col("timestamp")).alias(AT),
        F.floor(F.col("line_number") / settings.piece_lines).alias("_piece"),
        text.subnet(F.col("source_ip"), settings.travel_prefix_octets).alias("_net"),
    )
    piece = [*run, "user", AT, "_piece"]
    within = Window.partitionBy(*piece).orderBy("line_number")
    rows = logins.withColumn("_prev", F.lag("_net").over(within)).withColumn(
        "_last", F.last("_net").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    same_second = rows.filter(F.col("_prev") != F.col("_net")).select(*run, "line_number")

    heads = rows.filter(F.col("_prev").isNull()).select(*piece, "line_number", "_net", "_last")
    order = by_time([*run, "user"], "_piece")
    arrivals = (
        sliced(heads, back=window, ahead=0, settings=settings)
        .withColumn("_before", F.lag("_last").over(order))
        .withColumn("_before_at", F.lag(AT).over(order))
        .filter(own_slice(settings))
        .filter((F.col(AT) - F.col("_before_at") <= window) & (F.col("_before") != F.col("_net")))
        .select(*run, "line_number")
    )
    return same_second.unionByName(arrivals)


def flag_travel(events: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """Add ``impossible_travel``, true on the arriving login only."""
    lines = travel_lines(events, settings, run).withColumn("_hit", F.lit(True))
    marked = attach(events, lines, [*run, "line_number"], settings=settings)
    return marked.withColumn("impossible_travel", F.coalesce("_hit", F.lit(False))).drop("_hit")

"""Incidents: anomalies chained by a shared user or address within a window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions import text
from logwarden.functions.numbers import MINUTE, micros
from logwarden.operators.components import components
from logwarden.operators.joins import attach
from logwarden.operators.ordering import number_rows
from logwarden.session import settle

_AT, _BUCKET = "_at", "_bucket"
CELL = ("_user", "_ip", _BUCKET)
NAMELESS = "_user is null and _ip is null"


@dataclass(frozen=True)
class Incidents:
    """Numbered incidents as flagged events counted by cell, which is (user, address, bucket of time).

    ``cells`` holds ``run, _user, _ip, _bucket``, the sums of the cell and ``incident_id``; ``alone``
    the events without any identity: ``run, line_number``, the same sums and ``incident_id``.
    """

    cells: DataFrame
    alone: DataFrame

    def parts(self, columns: Sequence[str]) -> DataFrame:
        """Every incident once per cell or lone event."""
        return self.cells.select(*columns).unionByName(self.alone.select(*columns))


def _bucket(window: int) -> Column:
    """Time cut into pieces as wide as the window."""
    return F.floor(micros(F.col("timestamp")) / max(window, 1))


def _ip(by_source_ip: bool) -> Column:
    return text.identity_of(F.col("source_ip")) if by_source_ip else F.lit(None).cast("string")


def flagged_rows(
    events: DataFrame, settings: Settings = DEFAULTS, by_source_ip: bool = True, flag: str = "is_anomaly"
) -> DataFrame:
    """The flagged events that have a time, with ``_at`` and the columns of their cell."""
    window = settings.incident_window_minutes * MINUTE
    return events.filter(F.col(flag) & F.col("timestamp").isNotNull()).withColumns({
        _AT: micros(F.col("timestamp")), "_user": text.identity_of(F.col("user")), "_ip": _ip(by_source_ip),
        _BUCKET: _bucket(window),
    })


def single_cells(rows: DataFrame, run: Sequence[str] = (), sums: Sequence[str] = ("_rows",)) -> DataFrame:
    """Every named row as a cell of its own."""
    return rows.filter(f"not ({NAMELESS})").select(
        *run, *CELL, *sums, F.struct(_AT, "line_number").alias("_first"), F.col(_AT).alias("_last"),
        F.col("line_number").alias("_line"))


def merge_cells(parts: DataFrame, run: Sequence[str] = (), sums: Sequence[str] = ("_rows",)) -> DataFrame:
    """``_first`` is the first event, ``_last`` the last moment, ``_line`` the smallest line of a cell."""
    return parts.groupBy(*run, *CELL).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        F.min("_line").alias("_line"))


def _sessions(cells: DataFrame, key: str, kind: int, window: int, run: list[str]) -> DataFrame:
    """Chains of one identity: ``(run, key, bucket) -> node``.

    Rows of one bucket are always linked, so a bucket shrinks to its first and last
    moment, and a chain breaks only between buckets. A node is named after a line of
    its first bucket.
    """
    buckets = (
        cells.filter(F.col(key).isNotNull())
        .groupBy(*run, key, _BUCKET)
        .agg(F.min(f"_first.{_AT}").alias("_from"), F.max("_last").alias("_to"), F.min("_line").alias("_line"))
    )
    order = Window.partitionBy(*run, key).orderBy(_BUCKET)
    gap = F.col("_from") - F.lag("_to").over(order)
    name = F.when(gap.isNull() | (gap > window), F.col("_line") * 2 + kind)
    return buckets.withColumn("_new", name).select(
        *run, key, _BUCKET, F.last("_new", ignorenulls=True).over(order).alias(f"_{key}_node")
    )


def number_incidents(
    cells: DataFrame, alone: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = (),
    sums: Sequence[str] = ("_rows",),
) -> Incidents:
    """Incidents of settled ``cells``, numbered by first event from 0; ``alone`` holds rows without any identity.

    Every cell links the chain of its user to the chain of its address; the
    incidents are the components of that graph.
    """
    run = list(run)
    window = settings.incident_window_minutes * MINUTE
    users = _sessions(cells, "_user", 0, window, run)
    ips = _sessions(cells, "_ip", 1, window, run)
    linked = settle(
        cells.join(users, [*run, "_user", _BUCKET], "left").join(ips, [*run, "_ip", _BUCKET], "left")
    )
    edges = linked.filter(F.col("__user_node").isNotNull() & F.col("__ip_node").isNotNull()).select(
        *run, F.col("__user_node").alias("a"), F.col("__ip_node").alias("b")
    )
    roots = components(edges, run, settings)
    node = F.coalesce("__user_node", "__ip_node")
    rooted = (
        linked.withColumn("node", node)
        .join(roots, [*run, "node"], "left")
        .withColumn("_root", F.coalesce("root", "node"))
        .select(*run, *CELL, *sums, "_first", "_root")
    )
    # an event without any identity is an incident of its own; no chain has its name
    lone = alone.select(
        *run, *sums, (F.col("line_number") * 2).alias("_root"), F.struct(_AT, "line_number").alias("_first"),
    )
    starts = (
        rooted.select(*run, "_root", "_first").unionByName(lone.select(*run, "_root", "_first"))
        .groupBy(*run, "_root").agg(F.min("_first").alias("_first"))
        .select(*run, "_root", F.col(f"_first.{_AT}").alias(_AT), F.col("_first.line_number").alias("_line"))
    )
    ids = number_rows(starts, [_AT, "_line"], "incident_id", start=0, within=run).select(
        *run, "_root", "incident_id"
    )
    return Incidents(
        rooted.join(ids, [*run, "_root"]).select(*run, *CELL, *sums, "incident_id"),
        lone.join(ids, [*run, "_root"]).select(
            *run, F.col("_first.line_number").alias("line_number"), *sums, "incident_id"))


def assign_incidents(
    events: DataFrame,
    settings: Settings = DEFAULTS,
    run: Sequence[str] = (),
    by_source_ip: bool = True,
    flag: str = "is_anomaly",
) -> DataFrame:
    """The flagged events with ``incident_id``, numbered by first event from 0.

    Events that carry the same identities in the same bucket are one row until the
    ids are handed back.
    """
    run = list(run)
    rows = flagged_rows(events, settings, by_source_ip, flag).select(
        *run, "line_number", _AT, *CELL, F.lit(1).cast("bigint").alias("_rows"))
    cells = settle(merge_cells(single_cells(rows, run), run))
    found = number_incidents(cells, rows.filter(NAMELESS), settings, run)
    return tag_rows(events, found, settings, run, by_source_ip, flag)


def tag_rows(
    events: DataFrame,
    found: Incidents,
    settings: Settings = DEFAULTS,
    run: Sequence[str] = (),
    by_source_ip: bool = True,
    flag: str = "is_anomaly",
) -> DataFrame:
    """The flagged events with the ``incident_id`` of their cell or, without an identity, of their line."""
    run, blank = list(run), F.lit("")
    names = {c: F.coalesce(c, blank) for c in ("_user", "_ip")}
    tagged = flagged_rows(events, settings, by_source_ip, flag).withColumns(names).drop(_AT)
    known = (F.col("_user") != "") | (F.col("_ip") != "")
    by_cell = found.cells.withColumns(names).select(*run, *CELL, "_rows", "incident_id")
    by_line = found.alone.select(*run, "line_number", "incident_id")
    chained = attach(
        tagged.filter(known), by_cell, [*run, *CELL], how="inner", rows="_rows", settings=settings,
    )
    single = attach(tagged.filter(~known), by_line, [*run, "line_number"], how="inner", settings=settings)
    return chained.drop(*CELL).unionByName(single.drop(*CELL))

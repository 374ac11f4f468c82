"""Incidents under insertion: a batch touches only the chains it comes near.

The batch operator chains all flagged events of a log at once. Here the chains are kept
as tables, and a batch of new events, in any order of time, extends and merges them.

Time is cut into buckets as wide as the window, as in the batch operator. A cell is one
identity (user or address) in one bucket with its first and last moment, and a label of
its own. Cells of neighbouring buckets are linked if the gap between them is within the
window; an event links the cells of its user and of its address. More events only widen
a cell, so links are only added and incidents only merge. A batch therefore reads the
stored cells of its own and of the neighbouring buckets (in files by day), resolves
their labels, and finds components among those alone. What merges is written as a
relabel table ``(label, root)``: stored cells are never rewritten.

Every batch writes folders of its own number, so repeating a batch after a failure, as a
streaming sink does, replaces what it wrote before and changes nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions import text
from logwarden.functions.numbers import HOUR, MINUTE, micros
from logwarden.operators.components import components
from logwarden.operators.joins import attach
from logwarden.operators.ordering import number_rows
from logwarden.session import settle

DAY = 24 * HOUR
_CELL = ["kind", "value", "bucket"]
CELLS = "kind INT, value STRING, bucket BIGINT, first BIGINT, last BIGINT, label BIGINT, day BIGINT, batch BIGINT"
RELABELS = "label BIGINT, root BIGINT, batch BIGINT"
PRUNED_DAYS = 1_000  # a batch over more days reads all cells


@dataclass(frozen=True)
class BatchReport:
    """What one batch cost: cells it brought, stored cells it read, labels it merged."""

    new_cells: int
    read_cells: int
    merged: int


@dataclass(frozen=True)
class IncidentStore:
    """Chains of flagged events in the folder ``path``, which all executors share."""

    spark: SparkSession
    path: str
    settings: Settings = DEFAULTS
    by_source_ip: bool = True

    def _stored(self, name: str, schema: str, besides: int | None = None) -> DataFrame:
        try:
            table = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return table if besides is None else table.filter(F.col("batch") != besides)

    def _identified(self, events: DataFrame) -> DataFrame:
        """``line_number, at, bucket, user, ip`` of the events that have a time."""
        at = micros(F.col("timestamp"))
        ip = text.identity_of(F.col("source_ip")) if self.by_source_ip else F.lit(None).cast("string")
        return events.filter(F.col("timestamp").isNotNull()).select(
            "line_number", at.alias("at"), F.floor(at / max(self._window(), 1)).alias("bucket"),
            text.identity_of(F.col("user")).alias("user"), ip.alias("ip"))

    def _window(self) -> int:
        return self.settings.incident_window_minutes * MINUTE

    def _cells(self, rows: DataFrame) -> DataFrame:
        """One row per identity and bucket."""
        sides = F.array(F.struct(F.lit(0).alias("kind"), F.col("user").alias("value")),
                        F.struct(F.lit(1).alias("kind"), F.col("ip").alias("value")))
        every = rows.select("line_number", "at", "bucket", F.inline(sides)).filter(F.col("value").isNotNull())
        return every.groupBy(*_CELL).agg(
            F.min("at").alias("first"), F.max("at").alias("last"), (F.min("line_number") * 2 + F.col("kind")).alias("label"))

    def _resolved(self, cells: DataFrame, relabels: DataFrame) -> DataFrame:
        """``cells`` with ``root``: labels followed through the relabel table, touched ones only."""
        found = settle(cells.withColumn("root", F.col("label")))
        step = relabels.select(F.col("label").alias("root"), F.col("root").alias("_next"))
        while True:
            moved = settle(found.join(step, "root", "left").withColumn("_moved", F.col("_next").isNotNull()))
            found = moved.withColumn("root", F.coalesce("_next", "root")).drop("_next", "_moved")
            if moved.filter("_moved").isEmpty():
                return found

    def add(self, events: DataFrame, batch: int) -> BatchReport:
        """Insert the flagged ``events`` of one batch; their lines are in no other batch."""
        rows = settle(self._identified(events))
        fresh = settle(self._cells(rows))
        day = F.floor(F.col("bucket") * self._window() / DAY)
        days = [r[0] for r in fresh.select(F.explode(F.array(day - 1, day, day + 1)).alias("d")).distinct().limit(PRUNED_DAYS + 1).collect()]
        stored = self._stored("cells", CELLS, batch)
        if len(days) <= PRUNED_DAYS:
            stored = stored.filter(F.col("day").isin(days))
        near = fresh.select("kind", "value", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket")).distinct()
        touched = settle(stored.join(near, _CELL, "left_semi").groupBy(*_CELL).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.min("label").alias("label")))
        # a cell that is stored keeps its label, wherever its new lines stand
        known = touched.select(*_CELL, F.col("label").alias("_label"))
        fresh = fresh.join(known, _CELL, "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")
        both = fresh.withColumn("_new", F.lit(True)).unionByName(touched.withColumn("_new", F.lit(False))).groupBy(*_CELL).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.min("label").alias("label"), F.bool_or("_new").alias("new"))
        relabels = self._stored("relabels", RELABELS, batch)
        cells = settle(self._resolved(both, relabels))

        after = cells.select("kind", "value", (F.col("bucket") - 1).alias("bucket"), F.col("first").alias("_first"),
                             F.col("root").alias("b"), F.col("new").alias("_also"))
        beside = cells.join(after, _CELL).filter(
            (F.col("new") | F.col("_also")) & (F.col("_first") - F.col("last") <= self._window())).select(F.col("root").alias("a"), "b")
        pairs = rows.filter(F.col("user").isNotNull() & F.col("ip").isNotNull()).select("bucket", "user", "ip").distinct()
        users, ips = (cells.filter(F.col("kind") == kind).select(F.col("value").alias(name), "bucket", F.col("root").alias(end))
                      for kind, name, end in ((0, "user", "a"), (1, "ip", "b")))
        linked = pairs.join(users, ["user", "bucket"]).join(ips, ["ip", "bucket"]).select("a", "b")
        merged = settle(components(settle(beside.unionByName(linked).distinct()), settings=self.settings)
                        .filter(F.col("node") != F.col("root")).select(F.col("node").alias("label"), "root"))
        written = cells.filter("new").select(*_CELL, "first", "last", "label", day.alias("day"))
        written.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/cells/batch={batch}")
        merged.write.mode("overwrite").parquet(f"{self.path}/relabels/batch={batch}")
        return BatchReport(fresh.count(), touched.count(), merged.count())

    def incidents(self, events: DataFrame) -> DataFrame:
        """``line_number, incident_id`` of the flagged ``events``, all of them inserted before; numbered by first event from 0."""
        rows = settle(self._identified(events))
        labels = self._stored("cells", CELLS).groupBy(*_CELL).agg(F.min("label").alias("label"))
        roots = components(self._stored("relabels", RELABELS).select(F.col("label").alias("a"), F.col("root").alias("b")),
                           settings=self.settings).select(F.col("node").alias("label"), "root")
        named = labels.join(roots, "label", "left").withColumn("root", F.coalesce("root", "label"))
        side = F.when(F.col("user").isNotNull(), 0).when(F.col("ip").isNotNull(), 1)
        keyed = rows.select("line_number", "at", "bucket", side.alias("kind"), F.coalesce("user", "ip").alias("value"))
        # a busy cell may hold very many lines
        sizes = keyed.filter(F.col("kind").isNotNull()).groupBy(*_CELL).agg(F.count("*").alias("_rows"))
        chained = attach(keyed.filter(F.col("kind").isNotNull()), named.join(sizes, _CELL).select(*_CELL, "root", "_rows"), _CELL,
                         how="inner", rows="_rows", settings=self.settings).select("line_number", "at", "root")
        # an event without any identity is an incident of its own; no label is negative
        alone = keyed.filter(F.col("kind").isNull()).select("line_number", "at", (-F.col("line_number") - 1).alias("root"))
        every = settle(chained.unionByName(alone))
        starts = every.groupBy("root").agg(F.min(F.struct("at", "line_number")).alias("_first"), F.count("*").alias("_rows"))
        ids = number_rows(starts.select("root", "_first.*", "_rows"), ["at", "line_number"], "incident_id", start=0)
        return attach(every.select("line_number", "root"), ids.select("root", "incident_id", "_rows"), ["root"], how="inner",
                      rows="_rows", settings=self.settings).select("line_number", "incident_id")

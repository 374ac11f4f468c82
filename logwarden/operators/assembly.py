"""Incident tables: one row per incident, flat member tables, export records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, NARRATED_SEVERITIES, Settings
from logwarden.functions import text
from logwarden.operators.joins import attach, join_totals
from logwarden.operators.ordering import number_rows
from logwarden.operators.severity import highest_severity
from logwarden.operators.techniques import incident_techniques


def _moment(ts: Column) -> Column:
    """ISO-like text of an event time; a fraction shows only when there is one."""
    return ts.cast("string")


def incident_members(tagged: DataFrame, column: str, run: Sequence[str] = ()) -> DataFrame:
    """Distinct users or addresses of each incident, flat."""
    return tagged.filter(F.col(column).isNotNull()).select(*run, "incident_id", column).distinct()


def _listed(members: DataFrame, column: str, run: Sequence[str], name: str) -> DataFrame:
    """Members as one sorted array: the record's own field, built from distinct names."""
    return members.groupBy(*run, "incident_id").agg(F.array_sort(F.collect_set(column)).alias(name))


def _some_of(values: Column, count: Column) -> Column:
    shown = F.array_join(F.slice(values, 1, 3), ", ")
    more = F.when(count > 3, "...").otherwise("")
    return F.when(count == 0, "n/a").otherwise(F.concat(shown, more))


def incident_table(tagged: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """One row per incident; ``tagged`` is the output of ``assign_incidents`` with a severity."""
    incident = [*run, "incident_id"]
    flat = tagged.groupBy(*incident).agg(
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.count("*").alias("event_count"),
        highest_severity(F.col("severity")).alias("severity"),
    )
    users = _listed(incident_members(tagged, "user", run), "user", run, "users")
    ips = _listed(incident_members(tagged, "source_ip", run), "source_ip", run, "source_ips")
    techniques = (
        incident_techniques(tagged, settings, run)
        .groupBy(*incident)
        .agg(F.array_sort(F.collect_list(F.struct("position", "technique_id", "technique_name", "tactic", "evidence")))
             .alias("_techniques"))
    )
    none = F.array().cast("array<string>")
    no_techniques = F.array().cast(
        "array<struct<position:int,technique_id:string,technique_name:string,tactic:string,evidence:string>>"
    )
    whole = (
        flat.join(users, incident, "left").join(ips, incident, "left").join(techniques, incident, "left")
        .withColumn("users", F.coalesce("users", none))
        .withColumn("source_ips", F.coalesce("source_ips", none))
        .withColumn("_techniques", F.coalesce("_techniques", no_techniques))
    )
    return whole.select(
        *incident, describe(F.col("event_count"), F.col("users"), F.col("source_ips")).alias("summary"),
        "users", "source_ips", "start", "end", "event_count", "severity",
        F.transform("_techniques", lambda t: F.struct(
            t["technique_id"].alias("technique_id"), t["technique_name"].alias("technique_name"),
            t["tactic"].alias("tactic"), t["evidence"].alias("evidence"))).alias("mitre_techniques"),
        notable(F.col("severity"), F.col("event_count"), settings).alias("notable"),
    )


def describe(count: Column, users: Column, ips: Column) -> Column:
    """``N events | users: a, b, c... | source IPs: ...`` from real identities only."""
    def real(values: Column) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(values, text.identity_of))))

    parts = []
    for values in (real(users), real(ips)):
        parts.append(_some_of(values, F.size(values)))
    return F.concat(
        count.cast("string"), F.lit(" events | users: "), parts[0], F.lit(" | source IPs: "), parts[1]
    )


def notable(severity: Column, event_count: Column, settings: Settings = DEFAULTS) -> Column:
    """Worth a closer look: severe, or several events that support each other."""
    return severity.isin(*NARRATED_SEVERITIES) | (event_count >= settings.notable_min_events)


def incident_events(tagged: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Events of incidents as shown in an export: every missing value is an empty string."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return tagged.select(
        *run, "incident_id", "line_number", F.coalesce(_moment(F.col("timestamp")), F.lit("")).alias("timestamp"),
        shown("user"), shown("source_ip"), shown("message"),
    )


def incident_records(incidents: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Export records, one per incident at any size; its events are a table of their own."""
    return incidents.select(
        *run, "incident_id", "summary", "users", "source_ips", _moment(F.col("start")).alias("start"),
        _moment(F.col("end")).alias("end"), "event_count", "severity",
        F.transform("mitre_techniques", lambda t: F.struct(
            t["technique_id"].alias("technique_id"), t["technique_name"].alias("technique_name"),
            t["tactic"].alias("tactic"))).alias("mitre_techniques"),
    )


def incident_event_records(
    tagged: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()
) -> DataFrame:
    """Export records of events, flat, by ``(incident_id, position)`` in order of time and line."""
    incident = [*run, "incident_id"]
    events = number_rows(tagged, [*incident, "timestamp", "line_number"], "_at", start=0)
    firsts = events.groupBy(*incident).agg(F.min("_at").alias("_head"), F.count("*").alias("_rows"))
    placed = attach(events, firsts, incident, how="inner", rows="_rows", settings=settings)
    shown = incident_events(placed.withColumn("position", F.col("_at") - F.col("_head")), [*run, "position"])
    return shown.select(*incident, "position", "timestamp", "user", "source_ip", "message")


def run_counters(scored: DataFrame, incidents: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Rows, flagged rows, rows flagged by travel, incidents, incidents of several events."""
    rows = scored.groupBy(*run).agg(
        F.count("*").alias("log_rows"),
        F.count_if("is_anomaly").alias("flagged"),
        F.count_if("impossible_travel").alias("via_travel"),
    )
    grouped = incidents.groupBy(*run).agg(
        F.count("*").alias("incidents"), F.count_if(F.col("event_count") > 1).alias("multi_event")
    )
    if run:
        return rows.join(grouped, [*run], "left").fillna(0, ["incidents", "multi_event"])
    return join_totals(rows, grouped, [])

"""Views on the incident table for an analyst, and sample selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.operators.severity import severity_rank

# Names of the attack scenarios.
SCENARIOS = [
    ("A", "Brute force -> successful login -> privilege escalation"),
    ("B", "Impossible travel (same account, two distant source IPs)"),
    ("C", "Account enumeration (many usernames probed from one source IP)"),
]


def triage_order(incidents: DataFrame, limit: int | None = None) -> DataFrame:
    """Most corroborated first, then most severe, then oldest."""
    ordered = incidents.orderBy(
        F.desc("event_count"), F.desc(severity_rank(F.col("severity"))), F.asc("incident_id")
    )
    return ordered if limit is None else ordered.limit(limit)


def headline(incidents: DataFrame) -> DataFrame:
    """Totals of the board; ``hidden`` is what the default view leaves out."""
    return incidents.agg(
        F.count("*").alias("incidents"),
        F.count_if(F.col("severity") == "high").alias("high_severity"),
        F.count_if("notable").alias("notable"),
        F.count_if(~F.col("notable")).alias("hidden"),
    )


def select_incidents(
    incidents: DataFrame,
    show_all: bool = False,
    severities: Sequence[str] = ("high", "medium", "low"),
    user: str | None = None,
    only_with_technique: bool = False,
) -> DataFrame:
    kept = incidents if show_all else incidents.filter("notable")
    kept = kept.filter(F.col("severity").isin(*severities))
    if user is not None:
        kept = kept.filter(F.array_contains("users", user))
    if only_with_technique:
        kept = kept.filter(F.size("mitre_techniques") > 0)
    return kept


def user_facet(incidents: DataFrame) -> DataFrame:
    return incidents.select(F.explode("users").alias("user")).distinct().orderBy("user")


def incident_scenarios(tagged: DataFrame, labels: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """The scenario most labels of an incident carry; the smallest name wins a tie.

    Labels and events meet on (timestamp, user) within a run. A label counts once
    per incident however many events share its key.
    """
    incident = [*run, "incident_id"]
    keys = tagged.select(*incident, "timestamp", "user").distinct()
    hits = (
        labels.groupBy(*run, "timestamp", "user", "scenario").agg(F.count("*").alias("_n"))
        .join(keys, [*run, "timestamp", "user"])
        .groupBy(*incident, "scenario").agg(F.sum("_n").alias("_n"))
    )
    best = F.struct((-F.col("_n")).alias("n"), F.col("scenario").alias("scenario"))
    return hits.groupBy(*incident).agg(F.min(best).alias("_best")).select(
        *incident, F.col("_best.scenario").alias("scenario")
    )


def pick_samples(
    incidents: DataFrame, scenarios: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()
) -> DataFrame:
    """Per run and scenario the largest notable incident; the first one wins a tie."""
    order = Window.partitionBy(*run, "scenario").orderBy(F.desc("event_count"), F.asc("incident_id"))
    # limit per group: only the best row of each scenario leaves a map task
    return (
        incidents.filter("notable").join(scenarios, [*run, "incident_id"])
        .withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") == 1).drop("_nth")
    )


def uncovered_scenarios(samples: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Scenarios without a sample; of every run in ``runs``, if given."""
    if runs is None:
        names = samples.sparkSession.createDataFrame(SCENARIOS, "scenario STRING, title STRING")
        return names.join(samples, "scenario", "left_anti").orderBy("scenario")
    each = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(t).alias("title")) for s, t in SCENARIOS])
    names = runs.distinct().select("*", F.explode(each).alias("_s")).select(*runs.columns, "_s.*")
    return names.join(samples, [*runs.columns, "scenario"], "left_anti")

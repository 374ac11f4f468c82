"""Combination of detector flags and severity tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, SEVERITIES, Settings


def severity_rank(severity: Column) -> Column:
    """none < low < medium < high; anything else ranks like none."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.coalesce(severity, F.lit("")))
    return F.greatest(at - 1, F.lit(0)).cast("int")


def highest_severity(severity: Column) -> Column:
    """Aggregate: the highest label of a group."""
    return F.max_by(severity, severity_rank(severity))


def severity_of(anomaly: Column, score: Column, travel: Column, settings: Settings = DEFAULTS) -> Column:
    strength = -score
    return (
        F.when(travel, "high")
        .when(~anomaly, "none")
        .when(strength >= settings.severity_high, "high")
        .when(strength >= settings.severity_medium, "medium")
        .otherwise("low")
    )


def combine_flags(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Needs ``anomaly_score``, ``ml_anomaly`` and ``impossible_travel``."""
    anomaly = F.col("ml_anomaly") | F.col("impossible_travel")
    return scored.withColumn("is_anomaly", anomaly).withColumn(
        "severity", severity_of(anomaly, F.col("anomaly_score"), F.col("impossible_travel"), settings)
    )

"""From parsed events to scored events and incident tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.operators.assembly import incident_table
from logwarden.operators.embed import Encoder
from logwarden.operators.forest import score_events
from logwarden.operators.incidents import assign_incidents
from logwarden.operators.joins import attach
from logwarden.operators.rules import fired_rules
from logwarden.operators.severity import combine_flags
from logwarden.operators.travel import travel_lines
from logwarden.session import settle


@dataclass(frozen=True)
class Detection:
    scored: DataFrame
    tagged: DataFrame
    incidents: DataFrame


def flag_lines(
    rows: DataFrame,
    parsed: DataFrame,
    settings: Settings = DEFAULTS,
    run: Sequence[str] = (),
    with_rules: bool = True,
) -> DataFrame:
    """Add ``impossible_travel`` and, if asked, ``rules_fired`` to ``rows``.

    The flags are computed from the plain ``parsed`` events and reach ``rows``
    (events that already carry more columns) in a single join.
    """
    key = [*run, "line_number"]
    marks = travel_lines(parsed, settings, run).withColumns(
        {"impossible_travel": F.lit(True), "rules_fired": F.lit("")}
    )
    if with_rules:
        fired = fired_rules(parsed, settings, run).withColumn("impossible_travel", F.lit(False))
        marks = marks.unionByName(fired)
    flags = marks.groupBy(*key).agg(
        F.bool_or("impossible_travel").alias("impossible_travel"), F.max("rules_fired").alias("rules_fired")
    )
    if not with_rules:
        flags = flags.drop("rules_fired")
    absent = {"impossible_travel": False, "rules_fired": ""}
    return attach(rows, flags, key, settings=settings).fillna({c: v for c, v in absent.items() if c in flags.columns})


def score_log(
    parsed: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = (), encode: Encoder | None = None
) -> DataFrame:
    """Per-user outlier scores, the travel check and severity tiers."""
    scored = score_events(parsed, settings, run, encode)
    return combine_flags(flag_lines(scored, parsed, settings, run, with_rules=False), settings)


def detect(
    parsed: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = (), encode: Encoder | None = None
) -> Detection:
    """The whole detection of one log, or of many runs at once."""
    scored = settle(score_log(parsed, settings, run, encode))
    tagged = settle(assign_incidents(scored, settings, run))
    return Detection(scored, tagged, incident_table(tagged, settings, run))

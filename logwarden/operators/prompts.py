"""Prompt text per incident for whatever writer the user brings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions import text

# The wording of the prompt.
PROMPT = """You are a SOC analyst assistant. Below is a sequence of anomalous log events
from a single incident, along with MITRE ATT&CK techniques that were matched
by a grounded lookup table.

Incident summary:
{summary}

Incident events (chronological):
{events}

Matched MITRE ATT&CK techniques (grounded lookup, do not invent new ones):
{techniques}

Write a concise ({sentences} sentence) narrative explaining:
1. What likely happened, in plain English, in chronological order
2. Which MITRE ATT&CK stage(s) this incident progresses through
3. A confidence level (Low/Medium/High) and brief justification
4. One recommended next action for the analyst

Only reference technique IDs listed above. Do not invent new ones.
"""
NO_TECHNIQUE = "- No known technique matched; treat as a novel/unclassified anomaly."
TRAVEL_NOTE = "- Flagged by the impossible-travel physics check"


def _named(values: Column) -> tuple[Column, Column]:
    """Displayable distinct values as text, and how many there are."""
    shown = F.array_sort(F.array_distinct(F.array_compact(F.transform(values, text.field_of))))
    return F.when(F.size(shown) == 0, "n/a").otherwise(F.array_join(shown, ", ")), F.size(shown)


def summary_block(incident: Sequence[str], tagged: DataFrame, incidents: DataFrame) -> DataFrame:
    """Who, where, when and how many, as lines of text."""
    travel = tagged.groupBy(*incident).agg(
        F.bool_or("impossible_travel").alias("_travel") if "impossible_travel" in tagged.columns
        else F.lit(False).alias("_travel")
    )
    users, n_users = _named(F.col("users"))
    ips, n_ips = _named(F.col("source_ips"))
    lines = F.concat_ws(
        "\n",
        F.format_string("- %d anomalous events from %s to %s", F.col("event_count"),
                        F.col("start").cast("string"), F.col("end").cast("string")),
        F.format_string("- Distinct usernames involved (%d): %s", n_users, users),
        F.format_string("- Distinct source IPs (%d): %s", n_ips, ips),
        F.when(F.col("_travel"), TRAVEL_NOTE),
    )
    return incidents.join(travel, [*incident]).select(*incident, lines.alias("summary_block"))


def events_block(
    incident: Sequence[str], tagged: DataFrame, incidents: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The first events as lines, and a note on how many more there are.

    The cut to the first events happens before the shuffle (limit per group), so
    a huge incident sends only a few rows.
    """
    most = settings.prompt_max_events
    order = Window.partitionBy(*incident).orderBy("timestamp", "line_number")
    user, ip = text.field_of(F.col("user")), text.field_of(F.col("source_ip"))
    line = F.concat_ws(
        " ",
        F.concat(F.lit("- ["), F.col("timestamp").cast("string"), F.lit("]")),
        F.concat(F.lit("user="), user),
        F.concat(F.lit("src="), ip),
        F.concat(F.lit(": "), F.col("message")),
    )
    first = (
        tagged.select(*incident, "timestamp", "line_number", line.alias("_line"))
        .withColumn("_nth", F.row_number().over(order))
        .filter(F.col("_nth") <= most)
        .groupBy(*incident)
        .agg(F.array_sort(F.collect_list(F.struct("_nth", "_line"))).alias("_lines"))
    )
    rest = F.col("event_count") - most
    shown = F.array_join(F.transform("_lines", lambda e: e["_line"]), "\n")
    note = F.when(rest > 0, F.format_string("\n- ... and %d further similar events", rest)).otherwise("")
    return first.join(incidents.select(*incident, "event_count"), [*incident]).select(
        *incident, F.concat(shown, note).alias("events_block")
    )


def technique_block(techniques: Column) -> Column:
    lines = F.transform(techniques, lambda t: F.concat(
        F.lit("- "), t["technique_id"], F.lit(" ("), t["technique_name"], F.lit(") - "), t["tactic"],
        F.coalesce(F.concat(F.lit(" ["), t["evidence"], F.lit("]")), F.lit("")),
    ))
    return F.when(F.size(techniques) == 0, NO_TECHNIQUE).otherwise(F.array_join(lines, "\n"))


def incident_prompts(
    tagged: DataFrame, incidents: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()
) -> DataFrame:
    """``prompt`` per incident, with the three blocks it is made of."""
    incident = [*run, "incident_id"]
    blocks = (
        incidents.select(*incident, technique_block(F.col("mitre_techniques")).alias("technique_block"))
        .join(summary_block(incident, tagged, incidents), incident)
        .join(events_block(incident, tagged, incidents, settings), incident)
    )
    pieces: list[Column] = []
    slots = {"summary": F.col("summary_block"), "events": F.col("events_block"),
             "techniques": F.col("technique_block"), "sentences": F.lit(settings.prompt_sentences)}
    left = PROMPT
    for name, value in slots.items():
        before, left = left.split("{" + name + "}")
        pieces += [F.lit(before), value]
    return blocks.withColumn("prompt", F.concat(*pieces, F.lit(left)))

"""Fixed table schemas."""

from __future__ import annotations


def parsed_schema() -> str:
    return (
        "line_number BIGINT, timestamp TIMESTAMP_NTZ, host STRING, process STRING, pid STRING, "
        "message STRING, raw STRING, user STRING, source_ip STRING, template STRING"
    )


def labels_schema() -> str:
    return (
        "line_number BIGINT, timestamp TIMESTAMP_NTZ, user STRING, scenario STRING, "
        "instance INT, description STRING"
    )


def incident_schema(nested: bool = False) -> str:
    """One record per incident; ``nested`` for files of others that hold the events inside."""
    events = ", events ARRAY<STRUCT<timestamp: STRING, user: STRING, source_ip: STRING, message: STRING>>"
    return (
        "incident_id BIGINT, summary STRING, users ARRAY<STRING>, "
        "source_ips ARRAY<STRING>, start STRING, `end` STRING, event_count BIGINT, severity STRING, "
        "mitre_techniques ARRAY<STRUCT<technique_id: STRING, technique_name: STRING, tactic: STRING>>"
    ) + events * nested


def incident_events_schema() -> str:
    return "incident_id BIGINT, position BIGINT, timestamp STRING, user STRING, source_ip STRING, message STRING"

import json

import pytest
from pyspark.sql import functions as F

from helpers import TINY, incidents_pairwise, random_log
from logwarden.config import DEFAULTS
from logwarden.operators.assembly import incident_event_records, incident_records, incident_table, run_counters
from logwarden.operators.components import components
from logwarden.operators.incidents import assign_incidents
from logwarden.operators.prompts import incident_prompts
from logwarden.operators.techniques import incident_techniques, message_techniques
from logwarden.operators.triage import (headline, incident_scenarios, pick_samples, select_incidents, triage_order,
                                        uncovered_scenarios, user_facet)
from logwarden.sources import tables


def flagged(events):
    return events.withColumns({"is_anomaly": F.lit(True), "impossible_travel": F.lit(False), "severity": F.lit("low")})


def ids(df):
    return {r["line_number"]: r["incident_id"] for r in df.collect()}


SMOKE = [("2026-07-18 10:00:00", "alice", "10.0.0.5", "failed login"),
         ("2026-07-18 10:05:00", "alice", "10.0.0.5", "failed login"),
         ("2026-07-18 11:30:00", "alice", "10.0.0.5", "priv escalation"),
         ("2026-07-18 10:00:00", "bob", "10.0.0.9", "failed login"),
         ("2026-07-18 14:00:00", "root", "203.0.113.7", "failed password for root"),
         ("2026-07-18 14:01:00", "test", "203.0.113.7", "failed password for test"),
         ("2026-07-18 14:02:00", "guest", "203.0.113.7", "failed password for guest")]


def test_smoke(events_of):
    events = flagged(events_of(SMOKE))
    assert ids(assign_incidents(events)) == {1: 0, 2: 0, 4: 1, 3: 2, 5: 3, 6: 3, 7: 3}
    assert len(set(ids(assign_incidents(events, by_source_ip=False)).values())) == 6


def test_edges(events_of):
    events = flagged(events_of([
        ("2026-07-18 10:00:00", "a", "1.1.1.1", "x"), ("2026-07-18 10:30:00", "a", "2.2.2.2", "x"),   # exactly 30 min
        ("2026-07-18 10:31:00", "b", "2.2.2.2", "x"),                                                # by address
        ("2026-07-18 10:31:00", "unknown", None, "x"), ("2026-07-18 10:31:00", "Unknown", None, "x"),
        (None, "a", "1.1.1.1", "x"), ("2026-07-18 11:01:01", "b", None, "x")]))
    assert ids(assign_incidents(events)) == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 7: 3}


@pytest.mark.parametrize("settings, by_ip", [(DEFAULTS, True), (DEFAULTS, False), (TINY, True)],
                         ids=["default", "by user", "tiny limits"])
def test_against_pairwise_definition(events_of, settings, by_ip):
    users = ("a", "b", "c", "d", "e", "unknown")
    rows = random_log(160, 11, minutes=1500, users=users, ips=("1.1.1.1", "2.2.2.2", "3.3.3.3", None, None))
    found = assign_incidents(flagged(events_of(rows)), settings, by_source_ip=by_ip)
    assert ids(found) == incidents_pairwise(rows, by_ip=by_ip)


def test_no_anomalies(events_of):
    events = flagged(events_of(SMOKE)).withColumn("is_anomaly", F.lit(False))
    assert assign_incidents(events).count() == 0


@pytest.mark.parametrize("settings", [DEFAULTS, TINY], ids=["default", "tiny limits"])
def test_components(spark, settings):
    chain = [(i, i + 1) for i in range(1, 24)] + [(100, i) for i in range(101, 130)] + [(200, 200), (7, 7)]
    edges = spark.createDataFrame(chain, "a BIGINT, b BIGINT")
    roots = {r["node"]: r["root"] for r in components(edges, settings=settings).collect()}
    assert roots == {**{i: 1 for i in range(1, 25)}, **{i: 100 for i in range(100, 130)}}


def test_technique_smoke(events_of):
    events = events_of([("2026-07-18 10:00:00", "u", None, m) for m in (
        "Failed password for admin from 10.0.0.5 port 51422 ssh2", "sudo: alice : COMMAND=/bin/su root",
        "nmap scan detected from 10.0.0.9", "CRON[8124]: (root) CMD (run-parts /etc/cron.hourly)",
        "new user 'backdoor01' added to group sudo")])
    found = sorted((r["line_number"], r["ordinal"], r["technique_id"]) for r in message_techniques(events).collect())
    assert [(a, c) for a, _, c in found] == [(1, "T1110"), (2, "T1548"), (3, "T1046"), (5, "T1098"), (5, "T1136"), (5, "T1548")]


def techniques_of(tagged):
    rows = sorted((r["position"], r["technique_id"]) for r in incident_techniques(tagged).collect())
    return [t for _, t in rows]


def test_incident_techniques(events_of):
    probes = flagged(events_of([("2026-07-18 14:00:00", u, "203.0.113.7", f"Failed password for {u}")
                                for u in ("root", "test", "guest", "oracle")]))
    assert techniques_of(assign_incidents(probes)) == ["T1110", "T1087"]
    staged = flagged(events_of([("2026-07-18 02:00:00", "a", "1.1.1.1", "Failed password for a"),
                                ("2026-07-18 02:01:00", "a", None, "user=a : COMMAND=/bin/su root"),
                                ("2026-07-18 02:02:00", "a", None, "user=a added new user 'b' to group sudo")]))
    assert techniques_of(assign_incidents(staged)) == ["T1110", "T1548", "T1136"]
    moved = staged.withColumn("impossible_travel", F.col("line_number") == 1)
    assert techniques_of(assign_incidents(moved))[-1] == "T1021.004"


def test_table_summary_and_counters(events_of):
    events = flagged(events_of(SMOKE))
    table = incident_table(assign_incidents(events))
    rows = {r["incident_id"]: r for r in table.collect()}
    assert rows[0]["summary"] == "2 events | users: alice | source IPs: 10.0.0.5"
    assert rows[3]["users"] == ["guest", "root", "test"] and rows[3]["event_count"] == 3
    assert [m["technique_id"] for m in rows[3]["mitre_techniques"]] == ["T1110", "T1087"]
    assert [rows[i]["notable"] for i in range(4)] == [True, False, False, True]
    many = flagged(events_of([("2026-07-18 14:00:00", u, "203.0.113.7", "x") for u in ("d", "c", "b", "a", "unknown")]))
    only = incident_table(assign_incidents(many)).first()
    assert only["summary"] == "5 events | users: a, b, c... | source IPs: 203.0.113.7"
    assert only["users"] == ["a", "b", "c", "d", "unknown"]
    lone = flagged(events_of([("2026-07-18 14:00:00", "unknown", None, "x")]))
    assert incident_table(assign_incidents(lone)).first()["summary"] == "1 events | users: n/a | source IPs: n/a"
    counters = run_counters(events, table).first().asDict()
    assert counters == {"log_rows": 7, "flagged": 7, "via_travel": 0, "incidents": 4, "multi_event": 2}


@pytest.mark.parametrize("settings", [DEFAULTS, TINY], ids=["default", "tiny limits"])
def test_records_are_whole(spark, events_of, tmp_path, settings):
    tagged = assign_incidents(flagged(events_of(SMOKE)), settings)
    heads, events = str(tmp_path / "incidents"), str(tmp_path / "events")
    tables.write_incidents(incident_records(incident_table(tagged)), heads)
    tables.write_incident_events(incident_event_records(tagged, settings), events)
    back = sorted(tables.read_incidents(spark, heads).collect())
    assert [(r["incident_id"], r["event_count"]) for r in back] == [(0, 2), (1, 1), (2, 1), (3, 3)]
    assert back[0]["start"] == "2026-07-18 10:00:00"
    flat = sorted(tables.read_incident_events(spark, events).collect())
    assert [(r["incident_id"], r["position"]) for r in flat] == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2)]
    assert [r["message"][-4:] for r in flat if r["incident_id"] == 3] == ["root", "test", "uest"]


def test_json_array_source(spark, tmp_path):
    record = {"incident_id": 0, "summary": "s", "users": ["a"], "source_ips": [], "start": "x", "end": "y",
              "event_count": 1, "severity": "low", "mitre_techniques": [], "events": []}
    (tmp_path / "a.json").write_text(json.dumps([record, {**record, "incident_id": 1}], indent=2))
    assert tables.read_incidents(spark, str(tmp_path / "a.json"), array_file=True).count() == 2
    (tmp_path / "broken.json").write_text("[{")
    with pytest.raises(Exception):
        tables.read_incidents(spark, str(tmp_path / "broken.json"), array_file=True).collect()
    with pytest.raises(Exception):
        tables.read_incidents(spark, str(tmp_path / "missing.json"), array_file=True).collect()


def test_prompts(events_of):
    rows = [(f"2026-07-18 10:{i:02d}:00", "alice", "203.0.113.5" if i else None, f"Failed password {i}") for i in range(28)]
    rows.append(("2026-07-18 20:00:00", "unknown", None, "odd"))
    tagged = assign_incidents(flagged(events_of(rows)).withColumn("impossible_travel", F.col("line_number") == 3))
    found = {r["incident_id"]: r for r in incident_prompts(tagged, incident_table(tagged)).collect()}
    events = found[0]["events_block"].split("\n")
    assert len(events) == 26 and events[-1] == "- ... and 3 further similar events"
    assert events[0] == "- [2026-07-18 10:00:00] user=alice : Failed password 0"
    assert events[1] == "- [2026-07-18 10:01:00] user=alice src=203.0.113.5 : Failed password 1"
    assert found[0]["summary_block"].split("\n")[0] == (
        "- 28 anomalous events from 2026-07-18 10:00:00 to 2026-07-18 10:27:00")
    assert "Distinct usernames involved (1): alice" in found[0]["summary_block"]
    assert found[0]["summary_block"].endswith("physics check")
    assert found[0]["technique_block"].split("\n")[0] == "- T1110 (Brute Force) - Credential Access"
    assert "[Successful authentications" in found[0]["technique_block"]
    assert found[1]["technique_block"].startswith("- No known technique")
    assert "Distinct usernames involved (0): n/a" in found[1]["summary_block"]
    assert found[0]["prompt"].startswith("You are a SOC analyst") and "(4-6 sentence)" in found[0]["prompt"]


def test_triage(spark, events_of):
    tagged = assign_incidents(flagged(events_of(SMOKE)).withColumn(
        "severity", F.when(F.col("line_number") == 3, "high").otherwise("low")))
    table = incident_table(tagged)
    assert [r["incident_id"] for r in triage_order(table).collect()] == [3, 0, 2, 1]
    assert [r["incident_id"] for r in triage_order(table, 2).collect()] == [3, 0]
    assert headline(table).first().asDict() == {"incidents": 4, "high_severity": 1, "notable": 3, "hidden": 1}
    assert select_incidents(table).count() == 3
    assert select_incidents(table, show_all=True, user="bob").count() == 1
    assert select_incidents(table, severities=["high"]).count() == 1
    assert select_incidents(table, only_with_technique=True).count() == 1
    assert [r["user"] for r in user_facet(table).collect()] == ["alice", "bob", "guest", "root", "test"]
    labels = tagged.filter("line_number in (1, 2, 5)").select("timestamp", "user").withColumn(
        "scenario", F.when(F.col("user") == "root", "C").otherwise("A"))
    scenarios = incident_scenarios(tagged, labels)
    assert {(r["incident_id"], r["scenario"]) for r in scenarios.collect()} == {(0, "A"), (3, "C")}
    samples = pick_samples(table, scenarios)
    assert {r["scenario"]: r["incident_id"] for r in samples.collect()} == {"A": 0, "C": 3}
    assert [r["scenario"] for r in uncovered_scenarios(samples).collect()] == ["B"]


def test_scenario_tie_takes_the_smaller_name(events_of):
    tagged = assign_incidents(flagged(events_of(SMOKE)))
    labels = tagged.filter("line_number in (5, 6)").select("timestamp", "user").withColumn(
        "scenario", F.when(F.col("user") == "root", "C").otherwise("B"))
    assert incident_scenarios(tagged, labels).first()["scenario"] == "B"

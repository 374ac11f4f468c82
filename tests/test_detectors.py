import pytest

from helpers import TINY, brute_force_pairwise, enumeration_pairwise, lines_of, random_log, travel_pairwise
from logwarden.config import DEFAULTS
from logwarden.operators.rules import brute_force_lines, detect_by_rules, enumeration_lines, rule_counts
from logwarden.operators.severity import combine_flags
from logwarden.operators.travel import flag_travel, travel_lines


def accepted(user, ip):
    return f"Accepted password for {user} from {ip} port 51000 ssh2"


def failed(user, ip):
    return f"Failed password for {user} from {ip} port 51000 ssh2"


def test_rule_smoke(events_of):
    rows = [(f"2026-07-18 02:00:{i * 3:02d}", "alice", "203.0.113.9", failed("alice", "203.0.113.9")) for i in range(4)]
    rows += [("2026-07-18 02:00:20", "alice", "203.0.113.9", accepted("alice", "203.0.113.9")),
             ("2026-07-18 02:00:50", "alice", None, "user=alice : COMMAND=/bin/su root")]
    rows += [(f"2026-07-18 02:30:{n * 4:02d}", u, "198.51.100.7", failed(u, "198.51.100.7"))
             for n, u in enumerate(["ftpuser", "postgres", "test", "guest"])]
    rows += [("2026-07-18 10:00:00", "bob", "10.0.1.4", accepted("bob", "10.0.1.4")),
             ("2026-07-18 10:00:01", "bob", None, "pam_unix(sshd:session): session opened for user bob by (uid=0)"),
             ("2026-07-18 11:00:00", "carol", "10.0.2.8", failed("carol", "10.0.2.8"))]
    found = detect_by_rules(events_of(rows))
    flagged = found.filter("is_anomaly").collect()
    assert len(flagged) == 10
    assert not {"bob", "carol"} & {r["user"] for r in flagged}
    counts = {r["rule"]: r["lines_claimed"] for r in rule_counts(found).collect()}
    assert counts == {"brute_force": 5, "enumeration": 4, "privileged_command": 1}


def test_rules_are_joined_in_registry_order(events_of):
    rows = [(f"2026-07-18 02:00:0{i}", u, "1.1.1.1", failed(u, "1.1.1.1") + " su root")
            for i, u in enumerate(["a", "b", "c", "a", "a"])]
    found = {r["line_number"]: r["rules_fired"] for r in detect_by_rules(events_of(rows)).collect()}
    assert found[1] == "brute_force,enumeration,privileged_command"
    assert found[2] == "enumeration,privileged_command"


@pytest.mark.parametrize("second, ip, hit", [
    ("11:00:00", "203.0.113.44", True),
    ("11:00:01", "203.0.113.44", False),
    ("10:15:00", "10.0.200.1", False),
])
def test_travel_edges(events_of, second, ip, hit):
    events = events_of([("2026-07-18 10:00:00", "alice", "10.0.0.12", accepted("alice", "10.0.0.12")),
                        (f"2026-07-18 {second}", "alice", ip, accepted("alice", ip)),
                        ("2026-07-18 10:00:00", "bob", "10.0.1.9", accepted("bob", "10.0.1.9"))])
    assert lines_of(travel_lines(events)) == ([2] if hit else [])


def test_travel_looks_at_the_login_just_before(events_of):
    events = events_of([("2026-07-18 10:00:00", "a", "10.0.0.1", accepted("a", "x")),
                        ("2026-07-18 10:10:00", "a", "10.0.0.2", accepted("a", "x")),
                        ("2026-07-18 11:05:00", "a", "172.16.0.1", accepted("a", "x")),
                        ("2026-07-18 11:06:00", "a", "172.16.0.1", failed("a", "x"))])
    assert lines_of(travel_lines(events)) == [3]


def test_severity(spark, events_of):
    events = events_of([("2026-07-18 10:00:00", "alice", "10.0.0.12", accepted("alice", "x")),
                        ("2026-07-18 10:15:00", "alice", "203.0.113.44", accepted("alice", "x")),
                        ("2026-07-18 10:00:00", "bob", "10.0.1.9", accepted("bob", "x"))])
    from pyspark.sql import functions as F

    scored = flag_travel(events).withColumn("anomaly_score", F.lit(0.1)).withColumn("ml_anomaly", F.lit(False))
    assert {r["line_number"]: r["severity"] for r in combine_flags(scored).collect()} == {1: "none", 2: "high", 3: "none"}
    tiers = spark.createDataFrame([(-0.15,), (-0.149,), (-0.05,), (-0.01,)], "anomaly_score DOUBLE")
    tiers = tiers.withColumn("ml_anomaly", F.lit(True)).withColumn("impossible_travel", F.lit(False))
    assert [r["severity"] for r in combine_flags(tiers).collect()] == ["high", "medium", "medium", "low"]


@pytest.mark.parametrize("seed, settings", [(1, DEFAULTS), (2, TINY)], ids=["default", "tiny limits"])
def test_against_pairwise_definitions(events_of, seed, settings):
    rows = random_log(220, seed)
    events = events_of(rows)
    assert lines_of(travel_lines(events, settings)) == travel_pairwise(rows)
    assert lines_of(brute_force_lines(events, settings)) == brute_force_pairwise(rows)
    assert lines_of(enumeration_lines(events, settings)) == enumeration_pairwise(rows)


def test_runs_do_not_mix(spark, events_of):
    from pyspark.sql import functions as F

    rows = random_log(150, 5)
    events = events_of(rows)
    twice = events.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    half = twice.filter((F.col("seed") == 1) | (F.col("line_number") % 2 == 0))
    for rule in (travel_lines, brute_force_lines, enumeration_lines):
        both = rule(half, DEFAULTS, ["seed"])
        assert lines_of(both.filter("seed = 1")) == lines_of(rule(events))
        assert lines_of(both.filter("seed = 2")) == lines_of(rule(events.filter("line_number % 2 = 0")))


def test_a_third_of_the_log_in_one_second(spark):
    """Copies of one user and second are counted, never walked pairwise."""
    from pyspark.sql import functions as F

    hot = F.col("id") % 3 == 0
    events = spark.range(1, 300_001).select(
        F.col("id").alias("line_number"),
        F.when(hot, F.lit("2026-07-15 03:00:00").cast("timestamp_ntz")).otherwise(
            F.timestamp_add("SECOND", F.col("id"), F.lit("2026-07-14").cast("timestamp_ntz"))).alias("timestamp"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 5000).cast("string"))).alias("user"),
        F.lit("10.0.0.1").alias("source_ip"),
        F.when(F.col("id") % 2 == 0, "Failed password").otherwise("Accepted password").alias("message"))
    last = events.filter("line_number = 299997").withColumn("source_ip", F.lit("10.9.0.1"))
    every = events.filter("line_number <> 299997").unionByName(last)
    assert travel_lines(every).filter("line_number = 299997").count() == 1
    found = brute_force_lines(every).join(events.filter("user = 'hot'"), "line_number")
    assert found.count() == 100_000

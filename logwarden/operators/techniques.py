"""ATT&CK techniques of messages and incidents from a fixed lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions import text

# Public technique ids, names and tactics, with the words that point to them.
TECHNIQUES = [
    ("T1110", "Brute Force", "Credential Access",
     ["failed password", "authentication failure", "invalid user", "login attempt rejected",
      "invalid credentials"]),
    ("T1078", "Valid Accounts", "Initial Access / Persistence",
     ["accepted password", "session opened", "authentication succeeded", "successful auth"]),
    ("T1098", "Account Manipulation", "Persistence",
     ["usermod", "added to group", "gpasswd", "adduser"]),
    ("T1136", "Create Account", "Persistence",
     ["useradd", "new user", "creating user"]),
    ("T1548", "Abuse Elevation Control Mechanism", "Privilege Escalation",
     ["sudo", "command=", "su root", "privilege"]),
    ("T1053", "Scheduled Task/Job", "Persistence / Execution",
     ["crontab", "new cron job", "at job", "systemd-run"]),
    ("T1041", "Exfiltration Over C2 Channel", "Exfiltration",
     ["scp", "wget", "curl", "outbound connection"]),
    ("T1046", "Network Service Discovery", "Discovery",
     ["port scan", "nmap", "connection refused"]),
    ("T1070", "Indicator Removal", "Defense Evasion",
     ["log cleared", "truncated", "history -c", "unset histfile", "shred", "rm /var/log"]),
]
SIGNALS = [
    ("impossible_travel", "T1021.004", "Remote Services: SSH", "Lateral Movement",
     "Successful authentications from geographically implausible source IPs within a short window"),
    ("account_enumeration", "T1087", "Account Discovery", "Discovery",
     "{least}+ distinct usernames probed from a single source IP"),
]
_FIELDS = "ordinal INT, technique_id STRING, technique_name STRING, tactic STRING"


def technique_table(spark: SparkSession) -> DataFrame:
    rows = [(at, i, n, t, words) for at, (i, n, t, words) in enumerate(TECHNIQUES)]
    return spark.createDataFrame(rows, f"{_FIELDS}, keywords ARRAY<STRING>")


def signal_table(spark: SparkSession, settings: Settings = DEFAULTS) -> DataFrame:
    """Signals rank after every keyword technique, whatever the event order."""
    rows = [
        (len(TECHNIQUES) + at, i, n, t, signal, evidence.format(least=settings.enumeration_signal_users))
        for at, (signal, i, n, t, evidence) in enumerate(SIGNALS)
    ]
    return spark.createDataFrame(rows, f"{_FIELDS}, signal STRING, evidence STRING")


def technique_ordinals(message: Column) -> Column:
    """Array of table positions whose words occur in the message, in table order."""
    return F.array_compact(
        F.array(*[
            F.when(text.mentions(message, *words), F.lit(at))
            for at, (_, _, _, words) in enumerate(TECHNIQUES)
        ])
    )


def message_techniques(events: DataFrame) -> DataFrame:
    """One row per event and matching technique."""
    hits = events.withColumn("ordinal", F.explode(technique_ordinals(F.col("message"))))
    return hits.join(F.broadcast(technique_table(events.sparkSession).drop("keywords")), "ordinal")


def incident_signals(tagged: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """``(incident_id, signal)`` for patterns no single line shows."""
    incident = [*run, "incident_id"]
    found = []
    if "impossible_travel" in tagged.columns:
        found.append(tagged.filter("impossible_travel").select(*incident).distinct()
                     .withColumn("signal", F.lit("impossible_travel")))
    pairs = (
        tagged.filter(F.col("source_ip").isNotNull() & F.col("user").isNotNull())
        .select(*incident, "source_ip", "user").distinct()
    )
    wide = (
        pairs.groupBy(*incident, "source_ip").agg(F.count("*").alias("_users"))
        .filter(F.col("_users") >= settings.enumeration_signal_users)
        .select(*incident).distinct()
        .withColumn("signal", F.lit("account_enumeration"))
    )
    found.append(wide)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def incident_techniques(tagged: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """Techniques of each incident, once each, with ``position`` = first-seen order.

    Keyword techniques come by the first event that shows them and then by table
    order; signals come last. The first sighting is a minimum, so an incident of
    any size is reduced before it is shuffled.
    """
    spark = tagged.sparkSession
    incident = [*run, "incident_id"]
    seen = (
        tagged.select(*incident, "timestamp", "line_number",
                      F.explode(technique_ordinals(F.col("message"))).alias("ordinal"))
        .groupBy(*incident, "ordinal").agg(F.min(F.struct("timestamp", "line_number")).alias("_first"))
        .join(F.broadcast(technique_table(spark).drop("keywords")), "ordinal")
        .withColumn("signal", F.lit(None).cast("string"))
        .withColumn("evidence", F.lit(None).cast("string"))
    )
    signals = (
        incident_signals(tagged, settings, run)
        .join(F.broadcast(signal_table(spark, settings)), "signal")
        .withColumn("_first", F.lit(None).cast("struct<timestamp:timestamp_ntz,line_number:bigint>"))
    )
    every = seen.unionByName(signals.select(*seen.columns))
    # at most one entry per row of the two lookup tables
    entry = F.struct(
        F.col("_first").isNull().alias("late"), "_first", "ordinal", "technique_id", "technique_name", "tactic",
        "evidence",
    )
    listed = every.groupBy(*incident).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    return listed.select(*incident, F.posexplode("_all").alias("position", "_t")).select(
        *incident, "position", "_t.technique_id", "_t.technique_name", "_t.tactic", "_t.evidence"
    )

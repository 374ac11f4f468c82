"""The ``events`` table told as a system log, so that it can be parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.numbers import micros
from logwarden.operators.ordering import number_rows
from logwarden.sources.logs import format_line

# Account names that are probed but never log in.
PROBED = [
    "root", "test", "guest", "oracle", "postgres",
    "www-data", "ftpuser", "backup", "deploy", "support",
]


def account(user_id: Column, accounts: int = 50) -> Column:
    return F.concat(F.lit("u"), F.lpad((user_id % accounts).cast("string"), len(str(accounts - 1)), "0"))


def render_events(events: DataFrame, accounts: int = 50) -> DataFrame:
    """Syslog-shaped events: time runs ten times faster, whole seconds.

    Forty consecutive events form a block. Every 11th block comes from a foreign
    address and probes account names; every 22nd aims at one account.
    """
    block = F.floor(F.col("event_id") / 40)
    kind = F.col("event_type")
    home = F.col("user_id") % accounts
    since = micros(F.col("ts")) - micros(F.lit("2024-01-01").cast("timestamp_ntz"))
    seconds = F.floor(since / 10 / 1_000_000).cast("bigint")
    moment = F.timestamp_add("SECOND", seconds, F.lit("2026-07-14").cast("timestamp_ntz"))
    user = (
        F.when(kind.isin("error", "signup") & (block % 22 == 0), account(block, accounts))
        .when(
            (kind == "error") & (block % 11 == 0),
            F.element_at(F.array(*map(F.lit, PROBED)), (F.col("event_id") % 10 + 1).cast("int")),
        )
        .otherwise(account(F.col("user_id"), accounts))
    )
    ip = F.when(block % 11 == 0, F.concat(F.lit("203.0.113."), (block % 200 + 2).cast("string"))).otherwise(
        F.concat(F.lit("10."), F.floor(home / 250).cast("string"), F.lit("."), (home % 250).cast("string"),
                 F.lit("."), (F.col("event_id") % 5 + 2).cast("string"))
    )
    raised = F.col("event_id") % 17 == 0
    process = (
        F.when(kind == "view", "CRON")
        .when(kind == "purchase", F.when(raised, "sudo").otherwise("systemd"))
        .otherwise("sshd")
    )
    origin = F.concat(F.lit(" from "), F.col("ip"), F.lit(" port "),
                      (50000 + F.col("event_id") % 15000).cast("string"), F.lit(" ssh2"))
    message = (
        F.when(kind == "error", F.concat(F.lit("Failed password for "), F.col("usr"), origin))
        .when(kind == "signup", F.concat(F.lit("Accepted password for "), F.col("usr"), origin))
        .when(kind == "click", F.concat(F.lit("pam_unix(sshd:session): session opened for user "),
                                        F.col("usr"), F.lit(" by (uid=0)")))
        .when(kind == "view", F.lit("(root) CMD (run-parts /etc/cron.hourly)"))
        .otherwise(
            F.when(raised, F.concat(F.lit("user="), F.col("usr"), F.lit(" : COMMAND=/bin/su root"))).otherwise(
                F.concat(F.lit("Started Session "), (F.col("event_id") % 99 + 1).cast("string"),
                         F.lit(" of user "), F.col("usr"), F.lit("."))
            )
        )
    )
    return (
        events.select("event_id", "event_type", "user_id", moment.alias("ts"), user.alias("usr"), ip.alias("ip"),
                      process.alias("process"), (1000 + F.col("event_id") % 30000).cast("int").alias("pid"))
        .withColumn("message", message)
    )


def rendered_lines(events: DataFrame, accounts: int = 50) -> DataFrame:
    """``(line_number, value)`` of the rendered log in (time, event_id) order."""
    lines = render_events(events, accounts).select("ts", "event_id", format_line().alias("value"))
    return number_rows(lines, ["ts", "event_id"], "line_number").select("line_number", "value")

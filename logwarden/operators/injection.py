"""Labelled attack scenarios as table transforms.

A target row ``(seed, scenario, instance, user, home, day)`` becomes the events
of one attack. All randomness is drawn from (seed, scenario, instance, step), so
a corpus is the same under any partitioning, and no step needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions.numbers import draw, draw_between, pick
from logwarden.operators.ordering import number_rows
from logwarden.sources.logs import format_line

# Accounts with their home network, attack networks, probed names.
ACCOUNTS = [
    ("alice", "10.0.0."), ("bob", "10.0.1."), ("carol", "10.0.2."), ("dave", "10.0.3."), ("admin", "10.0.10."),
]
FOREIGN_NETWORKS = ["203.0.113.", "198.51.100.", "192.0.2."]
INSIDER_NETWORK = "172.16.5."
PROBED_NAMES = [
    "root", "test", "guest", "oracle", "postgres",
    "www-data", "ftpuser", "backup", "deploy", "support",
]
BRUTE_FORCE, TRAVEL, ENUMERATION = "A", "B", "C"
SCENARIO_CODES = [BRUTE_FORCE, TRAVEL, ENUMERATION]
DESCRIPTIONS = {
    "failed": "Rapid failed password attempts preceding compromise",
    "accepted": "Brute-force succeeds",
    "su": "Privilege escalation via sudo su",
    "group": "Persistence: backdoor account added to sudo group",
    "home": "Baseline login from usual location",
    "foreign": "Impossible travel: success from a different IP range 15 min later",
    "probe": "Account enumeration: many usernames probed from one source IP",
}
LABELLED = ["seed", "ts", "process", "pid", "message", "scenario", "instance", "user", "description", "step"]
KEY = ("seed", "scenario", "instance")


def _draw(n: int | Column, *what: Column | str | int) -> Column:
    return draw(n, *map(F.col, KEY), *what)


def _between(low: int, high: int, *what: Column | str | int) -> Column:
    return draw_between(low, high, *map(F.col, KEY), *what)


def _pick(values: list[str], *what: Column | str | int) -> Column:
    return pick(values, *map(F.col, KEY), *what)


def _after(start: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("bigint"), start)


def _host(network: Column | str, what: str) -> Column:
    network = network if isinstance(network, Column) else F.lit(network)
    return F.concat(network, _between(2, 250, what).cast("string"))


def _port(*what: Column | str | int) -> Column:
    return _between(50000, 65000, "port", *what).cast("string")


def _pid(*what: Column | str | int) -> Column:
    return (1000 + _draw(60000, "pid", *what)).cast("int")


def _login(verb: str, user: Column, ip: Column, port: Column) -> Column:
    return F.concat(F.lit(f"{verb} password for "), user, F.lit(" from "), ip, F.lit(" port "), port, F.lit(" ssh2"))


def _passed(gap, upto: Column) -> Column:
    """Seconds since the start: the sum of ``gap(step)`` for steps 1..upto."""
    steps = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + gap(step))


def plan_targets(
    spark: SparkSession,
    seeds: Sequence[int],
    settings: Settings = DEFAULTS,
    accounts: Sequence[tuple[str, str]] = tuple(ACCOUNTS),
    first_day: str = "2026-07-14",
) -> DataFrame:
    """Instances of every scenario for every seed, each with a drawn account and day."""
    users = F.array(*[F.struct(F.lit(u).alias("user"), F.lit(h).alias("home")) for u, h in accounts])
    plan = (
        spark.range(1, settings.instances_per_scenario + 1).select(F.col("id").cast("int").alias("instance"))
        .withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds])))
        .withColumn("scenario", F.explode(F.array(*map(F.lit, SCENARIO_CODES))))
    )
    chosen = F.element_at(users, (_draw(len(accounts), "user") + 1).cast("int"))
    return plan.withColumn("_account", chosen).select(
        *KEY, "_account.user", "_account.home",
        F.date_add(F.lit(first_day).cast("date"), _draw(settings.days, "day").cast("int")).alias("day"),
    )


def _start(low_hour: int, high_hour: int, high_minute: int) -> Column:
    minutes = _between(low_hour, high_hour, "hour") * 60 + _between(0, high_minute, "minute")
    return _after(F.col("day").cast("timestamp_ntz"), minutes * 60)


def inject_brute_force(targets: DataFrame) -> DataFrame:
    """Quick failures, a success, ``su`` to root, a new member of the sudo group."""
    tries = _between(3, 5, "tries").cast("int")
    step, n = F.col("step"), F.col("_tries")
    user = F.col("user")

    def gap(at: Column) -> Column:
        return (
            F.when(at <= n, _between(1, 4, at, "gap"))
            .when(at == n + 1, _between(15, 45, at, "gap"))
            .otherwise(_between(20, 60, at, "gap"))
        )

    ip, port = _host(INSIDER_NETWORK, "ip"), _port()
    # padded to two digits, never cut
    created = F.concat(F.lit("backdoor"), F.format_string("%02d", F.col("instance")))
    rows = (
        targets.filter(F.col("scenario") == BRUTE_FORCE)
        .withColumn("_tries", tries)
        .withColumn("step", F.explode(F.sequence(F.lit(0), n + 2)))
    )
    kind = F.when(step < n, "failed").when(step == n, "accepted").when(step == n + 1, "su").otherwise("group")
    kinds = rows.withColumn("_kind", kind)
    k = F.col("_kind")
    message = (
        F.when(k == "failed", _login("Failed", user, ip, port))
        .when(k == "accepted", _login("Accepted", user, ip, port))
        .when(k == "su", F.concat(F.lit("user="), user, F.lit(" : COMMAND=/bin/su root")))
        .otherwise(F.concat(F.lit("user="), user, F.lit(" added new user '"), created, F.lit("' to group sudo")))
    )
    process = F.when(k == "su", "sudo").when(k == "group", "usermod").otherwise("sshd")
    return _labelled(kinds, _after(_start(1, 5, 59), _passed(gap, step)), process, message, user, k)


def inject_travel(targets: DataFrame) -> DataFrame:
    """A login from home and, fifteen minutes later, one from a foreign network."""
    rows = (
        targets.filter(F.col("scenario") == TRAVEL)
        .withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_kind", F.when(F.col("step") == 0, "home").otherwise("foreign"))
    )
    ip = F.when(F.col("step") == 0, _host(F.col("home"), "home ip")).otherwise(
        _host(_pick(FOREIGN_NETWORKS, "network"), "foreign ip")
    )
    message = _login("Accepted", F.col("user"), ip, _port(F.col("step")))
    at = _after(_start(7, 20, 40), F.col("step") * 900)
    return _labelled(rows, at, F.lit("sshd"), message, F.col("user"), F.col("_kind"))


def inject_enumeration(targets: DataFrame) -> DataFrame:
    """Six to eight distinct account names probed from one foreign address."""
    keyed = [
        F.struct(F.md5(F.concat_ws("|", *map(F.col, KEY), F.lit(name))).alias("by"), F.lit(name).alias("name"))
        for name in PROBED_NAMES
    ]
    rows = (
        targets.filter(F.col("scenario") == ENUMERATION)
        .withColumn("_names", F.slice(F.array_sort(F.array(*keyed)), 1, _between(6, 8, "names").cast("int")))
        .select("*", F.posexplode("_names").alias("step", "_name"))
    )
    name = F.col("_name.name")
    ip = _host(_pick(FOREIGN_NETWORKS, "network"), "ip")
    at = _after(_start(0, 23, 59), _passed(lambda s: _between(2, 6, s, "gap"), F.col("step")))
    message = _login("Failed", name, ip, _port(F.col("step")))
    return _labelled(rows, at, F.lit("sshd"), message, name, F.lit("probe"))


def _labelled(rows: DataFrame, at: Column, process: Column, message: Column, user: Column, kind: Column) -> DataFrame:
    described = F.coalesce(*[F.when(kind == k, F.lit(text)) for k, text in DESCRIPTIONS.items()])
    return rows.select(
        "seed", at.alias("ts"), process.alias("process"), _pid(F.col("step")).alias("pid"), message.alias("message"),
        "scenario", "instance", user.alias("user"), described.alias("description"), "step",
    )


def inject(targets: DataFrame) -> DataFrame:
    """All labelled events of the targets."""
    return (
        inject_brute_force(targets).unionByName(inject_travel(targets)).unionByName(inject_enumeration(targets))
    )


def merge_corpus(background: DataFrame, attacks: DataFrame, run: Sequence[str] = ("seed",)) -> DataFrame:
    """Background and attacks in time order with line numbers and log lines.

    ``background`` holds ``(run..., ts, process, pid, message, step)`` without
    labels; equal times are ordered background first, then by scenario, instance
    and step.
    """
    run = list(run)
    columns = [*run, *[c for c in LABELLED if c not in run]]
    missing = [F.lit(None).cast(t).alias(c) for c, t in
               (("scenario", "string"), ("instance", "int"), ("user", "string"), ("description", "string"))
               if c not in background.columns]
    plain = background.select("*", *missing)
    every = plain.select(*columns).unionByName(attacks.select(*columns))
    return number_rows(every, corpus_order(), "line_number", within=run).withColumn("value", format_line())


def corpus_order() -> list[str | Column]:
    """Order of the lines of a corpus."""
    return ["ts", F.coalesce("scenario", F.lit("")), F.coalesce("instance", F.lit(0)), "step", "message", "pid"]

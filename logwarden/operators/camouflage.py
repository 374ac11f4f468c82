"""Disguises for labelled attack events; background rows are never touched.

Each strategy maps attack rows to attack rows and keeps the labels. Groups are
single attack instances, a handful of rows by construction of the scenarios.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions import text
from logwarden.functions.numbers import draw, draw_between, micros, pick
from logwarden.operators.injection import ACCOUNTS, FOREIGN_NETWORKS

# Wordings, disguises, filler lines and named combinations.
REPHRASINGS = [
    ("Failed password for",
     ["Authentication failure for", "Invalid credentials for", "Login attempt rejected for"]),
    ("Accepted password for",
     ["Authentication succeeded for", "Login accepted for", "Session established for"]),
    ("COMMAND=/bin/su root", ["COMMAND=/bin/bash -l", "COMMAND=/usr/bin/sudo -i"]),
    ("added new user", ["registered account", "provisioned account"]),
]
MIMICRY = "pam_unix(sudo:session): session opened for user {user} by (uid=0)"
FILLER = [
    ("CRON", "(root) CMD (run-parts /etc/cron.hourly)"),
    ("CRON", "(root) CMD (/usr/lib/php/sessionclean)"),
    ("systemd", "Started Session {n} of user {user}."),
    ("systemd", "Reloading system manager configuration."),
    ("systemd", "Starting Cleanup of Temporary Directories..."),
]
STRATEGIES = ["temporal", "slow", "rephrase", "mimicry", "noise", "volume", "ip_rotate"]
REALISTIC_COMBO = ["slow", "mimicry", "noise", "volume", "ip_rotate"]
ROBUSTNESS_CONDITIONS = {
    "baseline": [],
    **{name: [name] for name in STRATEGIES},
    "realistic-combo": REALISTIC_COMBO,
}
COMPARISON_CONDITIONS = {
    "clean": [],
    "mimicry": ["mimicry"],
    "rephrase": ["rephrase"],
    "realistic-combo": REALISTIC_COMBO,
}

INSTANCE = ("seed", "scenario", "instance")
ROW = (*INSTANCE, "step")


def _keys(names: Sequence[str] = ROW) -> list[Column]:
    return [F.col(n) for n in names]


def rephrase(attacks: DataFrame) -> DataFrame:
    """Replace the first known phrase of a message by an equivalent wording.

    A phrase is recognised in any case but replaced only as written.
    """
    message = F.col("message")
    said = F.lower(message)
    result = None
    for phrase, others in REPHRASINGS:
        new = F.replace(message, F.lit(phrase), pick(others, *_keys(), "rephrase"))
        found = said.contains(phrase.lower())
        result = F.when(found, new) if result is None else result.when(found, new)
    return attacks.withColumn("message", result.otherwise(message))


def mimic(attacks: DataFrame) -> DataFrame:
    """Word escalation lines like the most common benign line."""
    message = F.col("message")
    actor = F.coalesce(text.empty_to_null(F.col("user")), F.lit("root"))
    created = F.when(message.contains("'"), F.split(message, "'")[1]).otherwise(actor)
    before, after = MIMICRY.split("{user}")
    opened = F.concat(F.lit(before), created, F.lit(after))
    return attacks.withColumn(
        "message",
        F.when(message.contains("COMMAND=/bin/su root"), MIMICRY.format(user="root"))
        .when(message.contains("added new user"), opened)
        .otherwise(message),
    )


def rotate_ip(attacks: DataFrame) -> DataFrame:
    """Give each line an address of its own in place of its first one."""
    message = F.col("message")
    old = text.ip_of(message)
    new = F.concat(pick(FOREIGN_NETWORKS, *_keys(), "network"),
                   draw_between(2, 250, *_keys(), "address").cast("string"))
    at = F.instr(message, old)
    swapped = F.concat(
        F.substring(message, F.lit(1), at - 1), new, F.substring(message, at + F.length(old), F.length(message))
    )
    return attacks.withColumn("message", F.when(old.isNull(), message).otherwise(swapped))


def reduce_volume(attacks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Keep the first and last event of an instance and a share of those between."""
    at = F.struct("ts", "step")
    instance = Window.partitionBy(*INSTANCE)
    edge = (at == F.min(at).over(instance)) | (at == F.max(at).over(instance))
    lucky = draw(1_000_000, *_keys(), "keep") < int(settings.volume_keep * 1_000_000)
    return attacks.withColumn("_kept", edge | lucky).filter("_kept").drop("_kept")


def spread_times(attacks: DataFrame, minutes: tuple[int, int]) -> DataFrame:
    """Re-space each instance: the first event stays, the others follow in drawn gaps."""
    order = Window.partitionBy(*INSTANCE).orderBy("ts", "step")
    first = F.first("ts").over(order)
    gap = F.when(F.row_number().over(order) == 1, 0).otherwise(draw_between(*minutes, *_keys(), "gap"))
    passed = attacks.withColumn("_first", first).withColumn("_gap", gap)
    total = F.sum("_gap").over(order)
    return passed.withColumn("_total", total).withColumn(
        "ts", F.timestamp_add("MINUTE", F.col("_total").cast("bigint"), F.col("_first"))
    ).drop("_first", "_gap", "_total")


def noise_for(
    attacks: DataFrame, settings: Settings = DEFAULTS, users: Sequence[str] = tuple(u for u, _ in ACCOUNTS)
) -> DataFrame:
    """Unlabelled filler inside the time range of each instance."""
    spans = attacks.groupBy(*INSTANCE).agg(
        F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count("*").alias("_n")
    )
    seconds = F.greatest(
        F.floor((micros(F.col("_to")) - micros(F.col("_from"))) / 1_000_000), F.lit(60)
    )
    amount = F.floor(F.col("_n") * F.lit(settings.noise_ratio)).cast("int")
    rows = spans.withColumn("_seconds", seconds).filter(amount > 0).withColumn(
        "step", F.explode(F.sequence(F.lit(1), amount))
    )
    keys = [*_keys(), F.lit("noise")]
    which = draw(len(FILLER), *keys, "line")
    n = draw_between(1, 254, *keys, "n").cast("string")
    user = pick(list(users), *keys, "user")
    message = None
    for at, (_, template) in enumerate(FILLER):
        filled = F.replace(F.replace(F.lit(template), F.lit("{n}"), n), F.lit("{user}"), user)
        message = F.when(which == at, filled) if message is None else message.when(which == at, filled)
    process = F.element_at(F.array(*[F.lit(p) for p, _ in FILLER]), (which + 1).cast("int"))
    late = draw(F.col("_seconds") + 1, *keys, "at")
    made = rows.select(
        "seed", F.timestamp_add("SECOND", late, F.col("_from")).alias("ts"), process.alias("process"),
        F.when(process == "systemd", 1).otherwise(1000 + draw(60000, *keys, "pid")).cast("int").alias("pid"),
        message.alias("message"),
        F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("int").alias("instance"),
        F.lit(None).cast("string").alias("user"), F.lit(None).cast("string").alias("description"), "step",
    )
    return made


def camouflage(
    attacks: DataFrame,
    strategies: Sequence[str],
    settings: Settings = DEFAULTS,
    users: Sequence[str] = tuple(u for u, _ in ACCOUNTS),
) -> DataFrame:
    """Apply the chosen strategies in fixed order; noise spans the final times."""
    chosen = set(strategies)
    unknown = chosen - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    result = attacks
    if "volume" in chosen:
        result = reduce_volume(result, settings)
    if "rephrase" in chosen:
        result = rephrase(result)
    if "mimicry" in chosen:
        result = mimic(result)
    if "ip_rotate" in chosen:
        result = rotate_ip(result)
    if "slow" in chosen:
        result = spread_times(result, settings.slow_spread_minutes)
    elif "temporal" in chosen:
        result = spread_times(result, settings.spread_minutes)
    if "noise" in chosen:
        result = result.unionByName(noise_for(result, settings, users))
    return result

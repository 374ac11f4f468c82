"""The rule detector: burst, fan-out and privileged-command rules.

Each rule maps events to the line numbers it claims. Span rules work on one row
per (key, second): rows of one second share every span, so they are all claimed
or none is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, PRIVILEGE_KEYWORDS, Settings
from logwarden.functions import text
from logwarden.functions.numbers import MINUTE, micros
from logwarden.operators.joins import attach
from logwarden.operators.spans import AT, SLICE, by_time, own_slice, sliced

Rule = Callable[[DataFrame, Settings, Sequence[str]], DataFrame]


def brute_force_lines(events: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """Failed logins of a user that lie in a burst, and successes right after one.

    A second opens a burst when enough failures follow within the window, itself
    included. The burst ends at the last failure inside that window; a success is
    claimed when some burst ended at most one window before it.
    """
    key = [*run, "user"]
    window = settings.brute_force_window_minutes * MINUTE
    tried = (
        events.filter(F.col("timestamp").isNotNull() & F.col("user").isNotNull())
        .select(
            *key, "line_number", micros(F.col("timestamp")).alias(AT),
            text.is_failed_login(F.col("message")).alias("_failed"),
            text.is_accepted_login(F.col("message")).alias("_accepted"),
        )
        .filter(F.col("_failed") | F.col("_accepted"))
    )
    seconds = tried.groupBy(*key, AT).agg(
        F.count("*").alias("_rows"),
        F.count_if("_failed").alias("_fails"),
        F.count_if("_accepted").alias("_oks"),
    )
    order = by_time(key)
    ahead, back = order.rangeBetween(0, window), order.rangeBetween(-2 * window, 0)
    failed_at = F.when(F.col("_fails") > 0, F.col(AT))
    opens = (F.col("_fails") > 0) & (F.sum("_fails").over(ahead) >= settings.brute_force_min_failures)
    claimed = (
        sliced(seconds, back=2 * window, ahead=window, settings=settings)
        .withColumn("_end", F.when(opens, F.max(failed_at).over(ahead)))
        .withColumn("_open", F.when(F.col("_end").isNotNull(), F.col(AT)))
        .withColumn("_last_open", F.last("_open", ignorenulls=True).over(order))
        .withColumn("_ends", F.collect_set("_end").over(back))
        .filter(own_slice(settings))
        .select(
            *key, AT, "_rows",
            ((F.col("_fails") > 0) & F.coalesce(F.col(AT) - F.col("_last_open") <= window, F.lit(False)))
            .alias("_burst"),
            ((F.col("_oks") > 0)
             & F.exists("_ends", lambda end: (end <= F.col(AT)) & (F.col(AT) - end <= window)))
            .alias("_follows"),
        )
        .filter(F.col("_burst") | F.col("_follows"))
    )
    hits = attach(tried, claimed, [*key, AT], how="inner", rows="_rows", settings=settings)
    return hits.filter(
        (F.col("_failed") & F.col("_burst")) | (F.col("_accepted") & F.col("_follows"))
    ).select(*run, "line_number")


def enumeration_lines(events: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """Failed logins from an address that tries many user names within a window.

    Only the question "at least K names?" matters, so K names per second are
    enough; they are chosen before the rows are shuffled by address and slice.
    """
    key = [*run, "source_ip"]
    window = settings.enumeration_window_minutes * MINUTE
    least = settings.enumeration_min_users
    failed = events.filter(
        F.col("timestamp").isNotNull() & F.col("source_ip").isNotNull() & text.is_failed_login(F.col("message"))
    ).select(*key, "line_number", "user", micros(F.col("timestamp")).alias(AT))

    names = failed.groupBy(*key, AT, "user").agg(F.count("*").alias("_rows"))
    ranked = names.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, AT).orderBy("user")))
    few = ranked.filter(F.col("_nth") <= least).select(*key, AT, "user")
    order = by_time(key)
    opens = F.size(F.collect_set("user").over(order.rangeBetween(0, window))) >= least
    claimed = (
        sliced(few, back=window, ahead=window, settings=settings)
        .withColumn("_open", F.when(opens, F.col(AT)))
        .withColumn("_last_open", F.last("_open", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)))
        .filter(own_slice(settings) & (F.col(AT) - F.col("_last_open") <= window))
        .select(*key, AT)
        .distinct()
    )
    sizes = names.groupBy(*key, AT).agg(F.sum("_rows").alias("_rows"))
    weighed = claimed.join(sizes, [*key, AT])
    hits = attach(failed, weighed, [*key, AT], how="inner", rows="_rows", settings=settings)
    return hits.select(*run, "line_number")


def privileged_command_lines(
    events: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()
) -> DataFrame:
    """Lines that name a privileged command or a change of accounts."""
    return events.filter(text.mentions(F.col("message"), *PRIVILEGE_KEYWORDS)).select(*run, "line_number")


RULES: dict[str, Rule] = {
    "brute_force": brute_force_lines,
    "enumeration": enumeration_lines,
    "privileged_command": privileged_command_lines,
}


def fired_rules(
    events: DataFrame,
    settings: Settings = DEFAULTS,
    run: Sequence[str] = (),
    rules: dict[str, Rule] | None = None,
) -> DataFrame:
    """One row per claimed line with the names of its rules in registry order."""
    claims = [
        rule(events, settings, run).withColumn("_rule", F.struct(F.lit(at).alias("at"), F.lit(name).alias("name")))
        for at, (name, rule) in enumerate((rules or RULES).items())
    ]
    every = reduce(DataFrame.unionByName, claims)
    # a line has at most as many entries as there are rules
    named = every.groupBy(*run, "line_number").agg(F.array_sort(F.collect_set("_rule")).alias("_rules"))
    return named.select(
        *run, "line_number", F.array_join(F.transform("_rules", lambda r: r["name"]), ",").alias("rules_fired")
    )


def detect_by_rules(
    events: DataFrame,
    settings: Settings = DEFAULTS,
    run: Sequence[str] = (),
    rules: dict[str, Rule] | None = None,
) -> DataFrame:
    """Add ``rules_fired`` and ``is_anomaly``."""
    marked = attach(events, fired_rules(events, settings, run, rules), [*run, "line_number"], settings=settings)
    return marked.withColumn("rules_fired", F.coalesce("rules_fired", F.lit(""))).withColumn(
        "is_anomaly", F.col("rules_fired") != ""
    )


def rule_counts(detected: DataFrame, run: Sequence[str] = (), rules: dict[str, Rule] | None = None) -> DataFrame:
    """Lines claimed per rule."""
    names = F.array(*[F.lit(name) for name in (rules or RULES)])
    claimed = detected.select(*run, "rules_fired", F.explode(names).alias("rule"))
    return claimed.groupBy(*run, "rule").agg(
        F.count_if(F.col("rules_fired").contains(F.col("rule"))).alias("lines_claimed")
    )

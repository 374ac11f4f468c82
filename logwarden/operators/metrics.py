"""Counts first, rates last: evaluation of detectors against labelled lines.

Detectors are boolean columns of one event table. Counts of several runs are
summed before any rate is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.functions.numbers import rate, round3
from logwarden.operators.joins import attach, join_totals

DETECTORS = ("rules", "rules_travel", "embeddings", "travel_rule", "full")
LINE_COUNTS = ("tp", "fp", "fn", "flagged", "attack_lines", "instances", "instances_detected")
SCENARIO_COUNTS = ("tp", "attack_lines", "instances", "instances_detected")


def predictions(events: DataFrame) -> DataFrame:
    """One boolean column per detector from ``rules_fired``, ``impossible_travel``
    and, where present, ``ml_anomaly``."""
    travel = F.col("impossible_travel")
    rules = F.col("rules_fired") != ""
    marked = events.withColumns({"rules": rules, "rules_travel": rules | travel, "travel_rule": travel})
    if "ml_anomaly" in events.columns:
        marked = marked.withColumns({"embeddings": F.col("ml_anomaly"), "full": F.col("ml_anomaly") | travel})
    return marked


def _unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def label_hits(
    events: DataFrame, labels: DataFrame, detectors: Sequence[str], run: Sequence[str] = (),
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Labels with one boolean per detector; a line that is missing counts as not flagged."""
    key = [*run, "line_number"]
    seen = attach(events.select(*key, *detectors), labels.select(*key).distinct(), key, how="inner", settings=settings)
    return labels.join(seen, key, "left").fillna(False, list(detectors))


def instance_hits(hits: DataFrame, detectors: Sequence[str], run: Sequence[str] = ()) -> DataFrame:
    """Per detector and attack instance: labelled lines, lines hit."""
    long = _unpivot(hits, [*run, "scenario", "instance"], detectors, "detector", "hit")
    return long.groupBy(*run, "detector", "scenario", "instance").agg(
        F.count("*").alias("attack_lines"), F.count_if("hit").alias("tp")
    )


def scenario_counts(instances: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    return instances.groupBy(*run, "detector", "scenario").agg(
        F.sum("tp").alias("tp"),
        F.sum("attack_lines").alias("attack_lines"),
        F.count("*").alias("instances"),
        F.count_if(F.col("tp") > 0).alias("instances_detected"),
    )


def scenario_levels(per_scenario: DataFrame, over: Sequence[str]) -> DataFrame:
    """Counts on every level of ``over`` at once: one Expand and one aggregation.

    ``level`` has a bit for each column, the first one highest; it is set where the
    column is summed over (and null), so a missing value of its own stays apart.
    """
    return per_scenario.cube(*over).agg(
        F.grouping_id().cast("bigint").alias("level"), *[F.sum(c).cast("bigint").alias(c) for c in SCENARIO_COUNTS])


def flagged_lines(events: DataFrame, detectors: Sequence[str], run: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Flagged lines per run and detector; ``rows`` names a column that holds how many lines a row stands for."""
    lines = F.lit(1).cast("bigint") if rows is None else F.col(rows)
    totals = events.groupBy(*run).agg(
        *[F.coalesce(F.sum(F.when(F.col(d), lines)), F.lit(0).cast("bigint")).alias(d) for d in detectors])
    return _unpivot(totals, run, detectors, "detector", "flagged")


def confusion_counts(per_scenario: DataFrame, flagged: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, flagged lines and instance counts per run and detector."""
    sums = per_scenario.groupBy(*run, "detector").agg(*[F.sum(c).alias(c) for c in SCENARIO_COUNTS])
    return flagged.join(sums, [*run, "detector"], "left").fillna(0, list(SCENARIO_COUNTS)).select(
        *run, "detector", "tp", (F.col("flagged") - F.col("tp")).alias("fp"),
        (F.col("attack_lines") - F.col("tp")).alias("fn"), "flagged", "attack_lines", "instances",
        "instances_detected",
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and instance rate; 0.0 where nothing can be divided."""
    tp = F.col("tp")
    precision, recall = rate(tp, tp + F.col("fp")), rate(tp, tp + F.col("fn"))
    return counts.select(
        "*",
        round3(precision).alias("precision"),
        round3(recall).alias("recall"),
        round3(rate(2 * precision * recall, precision + recall)).alias("f1"),
        round3(rate(F.col("instances_detected"), F.col("instances"))).alias("instance_detection_rate"),
    )


def scenario_rates(counts: DataFrame) -> DataFrame:
    return counts.select(
        "*",
        round3(rate(F.col("tp"), F.col("attack_lines"))).alias("line_detection_rate"),
        round3(rate(F.col("instances_detected"), F.col("instances"))).alias("instance_detection_rate"),
    )


def pool_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum the counts of all runs that agree in ``by``, then take rates once."""
    return with_rates(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in LINE_COUNTS]))


def pool_scenarios(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return scenario_rates(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SCENARIO_COUNTS]))


def sweep_choice(pooled: DataFrame) -> DataFrame:
    """Best F1 (lowest share on a tie) and the cheapest share that misses no instance.

    ``noise_ratio`` compares lines flagged at 0.20 with those at the cheapest share;
    it is null unless that share is below 0.20.
    """
    complete = F.col("instance_detection_rate") >= 1.0
    share, flagged = F.col("share"), F.col("flagged")
    best = F.max(F.struct(F.col("f1").alias("f1"), (-share).alias("share")))
    cheapest = F.min(F.when(complete, F.struct(share.alias("share"), flagged.alias("flagged"))))
    current = F.max(F.when(F.abs(share - 0.20) < 1e-9, flagged))
    return pooled.agg(best.alias("b"), cheapest.alias("c"), current.alias("now")).select(
        (-F.col("b.share")).alias("best_f1_share"),
        F.col("c.share").alias("cheapest_complete_share"),
        F.when(
            F.col("c.share") < 0.20, F.bround(F.col("now") / F.greatest(F.col("c.flagged"), F.lit(1)), 1)
        ).alias("noise_ratio"),
    )


def mean_volume(volumes: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Floor of the mean over runs."""
    return volumes.groupBy(*by).agg(*[F.floor(F.sum(c) / F.count("*")).alias(c) for c in columns])


def robustness_counts(
    hits: DataFrame, run: Sequence[str] = ("seed", "condition"), detector: str = "full",
    travel: str = "travel_rule",
) -> DataFrame:
    """Per run and scenario: lines and instances caught, and lines caught by travel."""
    instances = hits.groupBy(*run, "scenario", "instance").agg(
        F.count("*").alias("attack_lines"), F.count_if(detector).alias("lines_detected"),
        F.count_if(travel).alias("impossible_travel_hits"),
    )
    counted = instances.groupBy(*run, "scenario").agg(
        F.sum("attack_lines").alias("attack_lines"),
        F.sum("lines_detected").alias("lines_detected"),
        F.count("*").alias("instances"),
        F.count_if(F.col("lines_detected") > 0).alias("instances_detected"),
        F.sum("impossible_travel_hits").alias("impossible_travel_hits"),
    )
    return _robust_rates(counted)


def _robust_rates(counts: DataFrame) -> DataFrame:
    return counts.select(
        "*",
        round3(rate(F.col("lines_detected"), F.col("attack_lines"))).alias("line_detection_rate"),
        round3(rate(F.col("instances_detected"), F.col("instances"))).alias("instance_detection_rate"),
    )


ROBUST = ("attack_lines", "lines_detected", "instances", "instances_detected")


def robustness_overall(counts: DataFrame, totals: DataFrame, run: Sequence[str] = ("seed", "condition")) -> DataFrame:
    """All scenarios of a run; ``totals`` brings ``total_flagged_lines`` and ``incidents``.

    A run without flagged lines or incidents counts none of them.
    """
    sums = counts.groupBy(*run).agg(*[F.sum(c).alias(c) for c in ROBUST])
    return _robust_rates(sums.join(totals, list(run), "left").fillna(0, ["total_flagged_lines", "incidents"]))


def pool_robustness(counts: DataFrame, by: Sequence[str] = ("condition", "scenario")) -> DataFrame:
    return _robust_rates(
        counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*ROBUST, "impossible_travel_hits")])
    )


def pool_robustness_overall(overall: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    """Summed over seeds, with the instance rate of every seed in seed order."""
    summed = (*ROBUST, "total_flagged_lines", "incidents")
    per_seed = F.array_sort(F.collect_list(F.struct("seed", "instance_detection_rate")))  # one entry per seed
    pooled = overall.groupBy(*by).agg(
        F.count("*").alias("seeds"), *[F.sum(c).alias(c) for c in summed], per_seed.alias("_rates")
    )
    return _robust_rates(pooled).withColumn(
        "per_seed_instance_rate", F.transform("_rates", lambda r: r["instance_detection_rate"])
    ).drop("_rates")


def rank_strategies(pooled: DataFrame, order: Sequence[str], clean: str = "baseline") -> DataFrame:
    """Conditions by loss of instances, then of lines, against the clean one."""
    base = pooled.filter(F.col("condition") == clean).select(
        F.col("instance_detection_rate").alias("_i"), F.col("line_detection_rate").alias("_l")
    )
    at = F.array_position(F.array(*map(F.lit, order)), F.col("condition"))
    compared = (
        join_totals(pooled.filter(F.col("condition") != clean), base, [])
        .select(
            "condition",
            "instance_detection_rate",
            round3(F.col("instance_detection_rate") - F.col("_i")).alias("instance_delta"),
            "line_detection_rate",
            round3(F.col("line_detection_rate") - F.col("_l")).alias("line_delta"),
            at.alias("_at"),
        )
    )
    # one row per condition
    place = F.row_number().over(Window.orderBy("instance_delta", "line_delta", "_at"))
    return compared.withColumn("rank", place).drop("_at")


def lossy_scenarios(per_scenario: DataFrame, clean: str = "baseline") -> DataFrame:
    """(scenario, condition) whose instance rate fell below the clean one."""
    base = per_scenario.filter(F.col("condition") == clean).select(
        "scenario", F.col("instance_detection_rate").alias("clean_rate")
    )
    return per_scenario.join(F.broadcast(base), "scenario").filter(
        F.col("instance_detection_rate") < F.col("clean_rate")
    ).select("scenario", "condition", "instance_detection_rate", "clean_rate")


def compensating_conditions(per_scenario: DataFrame, clean: str = "baseline") -> DataFrame:
    """Where more instances of the lossy scenario are caught than the travel rule explains.

    Empty unless all losses lie in one scenario.
    """
    lossy = lossy_scenarios(per_scenario, clean).agg(F.collect_set("scenario").alias("_lossy"))  # a few codes
    only = lossy.filter(F.size("_lossy") == 1).select(F.element_at("_lossy", 1).alias("scenario"))
    return per_scenario.join(only, "scenario").filter(
        F.col("instances_detected") > F.col("impossible_travel_hits")
    ).select("scenario", "condition", "instances_detected", "impossible_travel_hits")


def scenario_matrix(per_scenario: DataFrame, value: str, scenarios: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """Conditions down, scenarios across; null where a condition has no such scenario."""
    return per_scenario.groupBy("condition").pivot("scenario", list(scenarios)).agg(F.first(value))


def side_by_side(
    pooled: DataFrame, ids: Sequence[str], values: Sequence[str], first: str = "rules_travel", second: str = "full"
) -> DataFrame:
    """Two detectors in one row, with the difference of each value."""
    wide = pooled.groupBy(*ids).pivot("detector", [first, second]).agg(*[F.first(v).alias(v) for v in values])
    columns = []
    for v in values:
        a, b = (F.col(f"{d}_{v}") if len(values) > 1 else F.col(d) for d in (first, second))
        columns += [a.alias(f"{first}_{v}"), b.alias(f"{second}_{v}"), round3(b - a).alias(f"{v}_delta")]
    return wide.select(*ids, *columns)

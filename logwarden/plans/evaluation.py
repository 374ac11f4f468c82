"""The run matrix: every seed and condition is a pair of columns in one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.config import CONTAMINATION_SWEEP, DEFAULTS, Settings
from logwarden.operators.camouflage import camouflage
from logwarden.operators.forest import score_counts
from logwarden.operators.incidents import (
    CELL, NAMELESS, Incidents, assign_incidents, flagged_rows, merge_cells, number_incidents, single_cells, tag_rows,
)
from logwarden.operators.injection import inject
from logwarden.operators.joins import attach
from logwarden.operators.metrics import predictions
from logwarden.plans.detection import flag_lines
from logwarden.plans.matrix import RUN, RunMatrix, lay_out, with_verdicts
from logwarden.session import settle
from logwarden.sources.logs import format_line, parse_lines

CORPUS = ("ts", "process", "pid", "message", "scenario", "instance", "user", "description", "step", "value")


def build_corpora(
    background: DataFrame,
    targets: DataFrame,
    seeds: Sequence[int],
    conditions: Mapping[str, Sequence[str]],
    settings: Settings = DEFAULTS,
    users: Sequence[str] | None = None,
) -> DataFrame:
    """Numbered, labelled log lines of every (seed, condition)."""
    return run_matrix(background, targets, seeds, conditions, settings, users).expand(CORPUS)


def run_matrix(
    background: DataFrame,
    targets: DataFrame,
    seeds: Sequence[int],
    conditions: Mapping[str, Sequence[str]],
    settings: Settings = DEFAULTS,
    users: Sequence[str] | None = None,
) -> RunMatrix:
    """The same lines, the background kept once.

    ``background`` is shared by all runs; only the attacks differ.
    """
    attacks = settle(inject(targets))
    disguised = None
    for name, strategies in conditions.items():
        options = {} if users is None else {"users": users}
        rows = camouflage(attacks, strategies, settings, **options).withColumn("condition", F.lit(name))
        disguised = rows if disguised is None else disguised.unionByName(rows)
    runs = [(int(seed), name) for seed in seeds for name in conditions]
    return lay_out(background, settle(disguised), runs).each(lambda rows: rows.withColumn("value", format_line()))


def parse_matrix(matrix: RunMatrix, year: int | None = None) -> RunMatrix:
    """Parsed lines of all runs, those of the background parsed once."""

    def parse(rows: DataFrame) -> DataFrame:
        return parse_lines(rows.drop(*[c for c in CORPUS if c != "value"]), year).drop("raw", "host", "process", "pid")

    return matrix.each(parse)


def detect_all(
    parsed: DataFrame, settings: Settings = DEFAULTS, shares: Sequence[float] | None = None, run: Sequence[str] = RUN,
    flagged: bool = False,
) -> DataFrame:
    """Every detector on every run: ``rules_fired``, ``impossible_travel``, ``ml_anomaly``.

    With ``shares`` (a contamination sweep) a column ``full_<share>`` is added for
    each; the forests are fitted once. Rows that are ``flagged`` bring the first two.
    """
    run = list(run)
    counts = parsed.groupBy(*run, "user", "template").agg(F.count("*").alias("n"))
    wide = forest_verdicts(counts, settings, shares, run)
    scored = attach(parsed, wide, [*run, "user", "template"], how="inner", rows="n", settings=settings)
    return named_verdicts(scored if flagged else flag_lines(scored, parsed, settings, run), settings, shares)


def forest_verdicts(
    counts: DataFrame, settings: Settings = DEFAULTS, shares: Sequence[float] | None = None, run: Sequence[str] = RUN
) -> DataFrame:
    """One row per (run, user, template) of the counted lines, with a verdict for each share."""
    run = list(run)
    wanted = _wanted(settings, shares)
    verdicts = score_counts(counts, settings, run, list(wanted))
    return verdicts.groupBy(*run, "user", "template").agg(
        F.first("n").alias("n"),
        F.first(F.when(F.col("share") == settings.contamination, F.col("anomaly_score")), ignorenulls=True)
        .alias("anomaly_score"),
        *[F.bool_or((F.col("share") == s) & F.col("ml_anomaly")).alias(c) for s, c in wanted.items()],
    )


def _wanted(settings: Settings, shares: Sequence[float] | None) -> dict[float, str]:
    return {s: f"_ml_{i}" for i, s in enumerate(sorted({settings.contamination, *(shares or ())}))}


def named_verdicts(marked: DataFrame, settings: Settings = DEFAULTS, shares: Sequence[float] | None = None) -> DataFrame:
    """``ml_anomaly`` and the columns of a sweep in place of those of ``forest_verdicts``."""
    columns = _wanted(settings, shares)
    named = {"ml_anomaly": F.col(columns[settings.contamination])}
    named |= {sweep_column(s): F.col(columns[s]) | F.col("impossible_travel") for s in (shares or ())}
    return marked.withColumns(named).drop(*columns.values())


@dataclass(frozen=True)
class MatrixVerdicts:
    """Every detector on runs that share a background: ``counts`` are lines (``n``) by run and verdicts,
    ``own`` the lines that the runs add, one by one; ``forest`` holds verdicts by (run, user, template)."""

    counts: DataFrame
    own: DataFrame
    forest: DataFrame


def detect_matrix(
    judged: RunMatrix, settings: Settings = DEFAULTS, shares: Sequence[float] | None = None,
    conditions: Sequence[str] | None = None,
) -> MatrixVerdicts:
    """``detect_all`` without the lines of the background in every run; ``judged`` has rule and travel verdicts."""
    key = [*RUN, "user", "template"]
    cells = settle(judged.tally(["user", "template"], conditions))
    forest = settle(forest_verdicts(cells.select(*key, "n"), settings, shares))
    own = judged.own if conditions is None else judged.own.filter(F.col("condition").isin(list(conditions)))

    def marked(rows: DataFrame) -> DataFrame:
        found = with_verdicts(attach(rows, forest.drop("n", "anomaly_score"), key, how="inner", settings=settings))
        return predictions(named_verdicts(found, settings, shares)).drop("user", "template")

    found = marked(cells)
    verdicts = [c for c in found.columns if c not in (*RUN, "n")]
    counts = found.groupBy(*RUN, *verdicts).agg(F.sum("n").alias("n"))
    return MatrixVerdicts(settle(counts), settle(marked(own.select(*key, "line_number", "_bits"))), forest)


_SUMS = ("_rows", "_severe")
_INCIDENT = ("timestamp", "user", "source_ip")


def _flagged(lines: DataFrame, settings: Settings) -> DataFrame:
    marked = predictions(with_verdicts(lines))
    return flagged_rows(marked, settings, flag="rules_travel").withColumns(
        {"_rows": F.lit(1).cast("bigint"), "_severe": F.col("impossible_travel").cast("bigint")})


def run_incidents(judged: RunMatrix, settings: Settings = DEFAULTS) -> Incidents:
    """Incidents of the lines that rules or travel flag, for every run; ``_severe`` counts those of travel.

    Equal to ``assign_incidents`` over all lines of all runs, but lines of the background are
    counted by cell once. A run gets these counts, its own rows and the rows whose verdicts differ.
    """
    steady, moving = judged.by_verdicts()
    few = settle(_flagged(moving.expand(_INCIDENT), settings).select(*RUN, "line_number", "_at", *CELL, *_SUMS))
    base = _flagged(steady.shared, settings).withColumn("line_number", judged.place())
    named = settle(merge_cells(single_cells(base, sums=_SUMS), sums=_SUMS))
    first, line = F.col("_first.line_number"), F.col("_line")
    every = judged.in_runs(judged.in_runs(named, line, "_line"), first, "_first_line").select(
        F.explode(F.arrays_zip("_line", "_first_line", F.sequence(F.lit(0), F.lit(len(judged.runs) - 1)).alias("at"))).alias("_r"),
        *CELL, *_SUMS, F.col("_first._at").alias("_at"), "_last")
    shared = every.select(
        *judged.run_of(F.col("_r.at")), *CELL, *_SUMS, F.struct("_at", F.col("_r._first_line").alias("line_number")).alias("_first"),
        "_last", F.col("_r._line").alias("_line"))
    own = single_cells(few, RUN, _SUMS)
    cells = settle(merge_cells(shared.unionByName(own), RUN, _SUMS))
    nameless = base.filter(NAMELESS).select("line_number", "_at", *_SUMS)
    lone = judged.in_runs(nameless, F.col("line_number"), "_lines").select(
        F.posexplode("_lines").alias("_r", "line_number"), "_at", *_SUMS)
    alone = lone.select(*judged.run_of(F.col("_r")), "line_number", "_at", *_SUMS).unionByName(
        few.filter(NAMELESS).select(*RUN, "line_number", "_at", *_SUMS))
    found = number_incidents(cells, settle(alone), settings, RUN, _SUMS)
    return Incidents(settle(found.cells), settle(found.alone))


def tag_labelled(judged: RunMatrix, found: Incidents, labels: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Flagged lines of the runs at a time and user of one of their ``labels``, with their incident."""
    key = ["timestamp", "user"]
    near = replace(judged, shared=attach(judged.shared, labels.select(*key).distinct(), key, how="inner", settings=settings))
    lines = near.expand(_INCIDENT).join(labels.select(*RUN, *key).distinct(), [*RUN, *key], "left_semi")
    lines = settle(predictions(with_verdicts(lines)))
    rows = flagged_rows(lines, settings, flag="rules_travel")
    cells = settle(rows.select(*RUN, *CELL).distinct())
    same = reduce(lambda a, b: a & b, [found.cells[c].eqNullSafe(cells[c]) for c in (*RUN, *CELL)])
    cells = found.cells.join(F.broadcast(cells) if cells.count() <= settings.broadcast_rows else cells, same, "left_semi")
    return tag_rows(lines, replace(found, cells=cells), settings, RUN, flag="rules_travel")


def sweep_column(share: float) -> str:
    return f"full_{round(share * 100):02d}"


def sweep_columns(shares: Sequence[float] = CONTAMINATION_SWEEP) -> dict[str, float]:
    return {sweep_column(s): s for s in shares}


def alert_volume(predicted: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = RUN) -> DataFrame:
    """Lines and incidents per run for the fair rule detector and the full system.

    ``rule_incidents`` groups what the rule detector flags. The published figure
    groups only those of its lines the full system flags too; that count is
    ``rule_incidents_also_full``.
    """
    run = list(run)
    lines = predicted.groupBy(*run).agg(F.count("*").alias("log_lines"))
    shared = predicted.withColumn("_both", F.col("rules_travel") & F.col("full"))
    for flag, name in (("rules_travel", "rule_incidents"), ("_both", "rule_incidents_also_full"),
                       ("full", "full_incidents")):
        tagged = assign_incidents(shared, settings, run, flag=flag)
        counts = tagged.groupBy(*run).agg((F.max("incident_id") + 1).alias(name))
        lines = lines.join(counts, run, "left").fillna(0, [name])
    return lines

"""Tables the registered queries share, derived once per session and data folder."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.config import CONTAMINATION_SWEEP, Settings
from logwarden.functions.numbers import draw
from logwarden.operators.assembly import incident_table
from logwarden.operators.camouflage import COMPARISON_CONDITIONS, ROBUSTNESS_CONDITIONS
from logwarden.operators.incidents import Incidents, assign_incidents
from logwarden.operators.injection import KEY, SCENARIO_CODES, plan_targets
from logwarden.operators.joins import attach
from logwarden.operators.metrics import predictions
from logwarden.operators.severity import combine_flags
from logwarden.plans.detection import flag_lines, score_log
from logwarden.plans.evaluation import RUN, MatrixVerdicts, detect_matrix, named_verdicts, parse_matrix, run_incidents, run_matrix, tag_labelled
from logwarden.plans.matrix import RunMatrix, judge, with_verdicts
from logwarden.session import ensure_checkpoint_dir, settle
from logwarden.sources.logs import parse_lines
from logwarden.sources.rendered import account, render_events, rendered_lines
from logwarden.sources.tables import labels_of

YEAR = 2026
SEEDS = (42, 43, 44, 45, 46)
SETTINGS = Settings(days=3)  # the rendered log spans three days
USERS = tuple(f"u{n:02d}" for n in range(50))
HOMES = tuple((f"u{n:02d}", f"10.0.{n}.") for n in range(50))

_memo: dict[tuple, DataFrame | RunMatrix | MatrixVerdicts | Incidents] = {}


def shared(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Settle the table on first use in a session; later queries read it back."""

    @functools.wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (build.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _memo:
            _memo[key] = settle(build(spark, sf_dir))
        return _memo[key]

    return get


def remembered[T](build: Callable[[SparkSession, str], T]) -> Callable[[SparkSession, str], T]:
    """Build the runs or their verdicts, whose tables are settled, once in a session."""

    @functools.wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> T:
        key = (build.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _memo:
            _memo[key] = build(spark, sf_dir)
        return _memo[key]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@shared
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_lines(table(spark, sf_dir, "events"))


@shared
def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(lines(spark, sf_dir), YEAR)


@shared
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and travel together, with a score any engine can compute in place of
    the forest's, so that everything behind detection can be compared in SQL."""
    rows = parsed(spark, sf_dir)
    ruled = flag_lines(rows, rows)
    score = -(F.col("line_number") % 40) / F.lit(200.0)
    verdict = ruled.withColumns({"anomaly_score": score, "ml_anomaly": F.col("rules_fired") != ""})
    return combine_flags(verdict).drop("ml_anomaly")


@shared
def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_incidents(judged(spark, sf_dir))


@shared
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_table(tagged(spark, sf_dir))


@shared
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_log(parsed(spark, sf_dir))


@shared
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instance of every scenario for every user id of ``events``."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    plan = users.select(
        F.lit(42).cast("bigint").alias("seed"),
        F.explode(F.array(*map(F.lit, SCENARIO_CODES))).alias("scenario"),
        F.col("user_id").cast("int").alias("instance"),
        account(F.col("user_id")).alias("user"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 50).cast("string"), F.lit(".")).alias("home"),
    )
    day = F.date_add(F.lit("2026-07-14").cast("date"), draw(3, *map(F.col, KEY), "day").cast("int"))
    return plan.withColumn("day", day)


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = render_events(table(spark, sf_dir, "events"))
    return rendered.select("ts", "process", "pid", "message", F.col("event_id").cast("int").alias("step"))


def matrix_targets(spark: SparkSession) -> DataFrame:
    return plan_targets(spark, SEEDS, SETTINGS, HOMES)


@remembered
def matrix(spark: SparkSession, sf_dir: str) -> RunMatrix:
    """Five seeds, nine conditions, the whole rendered log as background of each."""
    return run_matrix(
        background(spark, sf_dir), matrix_targets(spark), SEEDS, ROBUSTNESS_CONDITIONS, SETTINGS, USERS
    )


@shared
def corpora_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_of(matrix(spark, sf_dir).own)  # no line of the background has a label


@remembered
def judged_matrix(spark: SparkSession, sf_dir: str) -> RunMatrix:
    """Parsed lines with rule and travel verdicts of every run."""
    return judge(parse_matrix(matrix(spark, sf_dir), YEAR))


def corpora_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and travel verdicts of every run."""
    return predictions(with_verdicts(judged_matrix(spark, sf_dir).expand(["timestamp", "message", "user", "source_ip"])))


def corpora_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every run counted by verdict (``n``)."""
    return predictions(with_verdicts(judged_matrix(spark, sf_dir).tally([])))


def corpora_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the lines that runs add to the background; no other line has a label."""
    return predictions(with_verdicts(judged_matrix(spark, sf_dir).own.select(*RUN, "line_number", "_bits")))


@remembered
def corpora_incidents(spark: SparkSession, sf_dir: str) -> Incidents:
    """Incidents of the lines of every run that rules or travel flag."""
    return run_incidents(judged_matrix(spark, sf_dir))


def corpora_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those incidents as counted lines (``n``); travel is severe."""
    parts = corpora_incidents(spark, sf_dir).parts([*RUN, "incident_id", "_rows", "_severe"])
    return parts.select(*RUN, "incident_id", F.col("_rows").alias("n"), F.when(F.col("_severe") > 0, "high").otherwise("low").alias("severity"))


@shared
def corpora_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every run that rules or travel flag at the time and user of a label, with their incident."""
    return tag_labelled(judged_matrix(spark, sf_dir), corpora_incidents(spark, sf_dir), corpora_labels(spark, sf_dir))


def _detected(spark: SparkSession, sf_dir: str, conditions: Collection[str], shares: Sequence[float] | None = None) -> MatrixVerdicts:
    """All detectors of the runs under ``conditions``."""
    return detect_matrix(judged_matrix(spark, sf_dir), shares=shares, conditions=list(conditions))


@remembered
def clean_full(spark: SparkSession, sf_dir: str) -> MatrixVerdicts:
    """All detectors of the clean runs, with the contamination sweep."""
    return _detected(spark, sf_dir, ["baseline"], CONTAMINATION_SWEEP)


@remembered
def disguised_full(spark: SparkSession, sf_dir: str) -> MatrixVerdicts:
    """All detectors of the disguised runs that the detectors are compared on."""
    return _detected(spark, sf_dir, set(COMPARISON_CONDITIONS) & set(ROBUSTNESS_CONDITIONS))


@remembered
def other_full(spark: SparkSession, sf_dir: str) -> MatrixVerdicts:
    """All detectors of the other runs of the robustness matrix."""
    return _detected(spark, sf_dir, set(ROBUSTNESS_CONDITIONS) - set(COMPARISON_CONDITIONS) - {"baseline"})


@shared
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors on every line of the clean runs."""
    columns = ["timestamp", "user", "source_ip", "template"]
    rows = with_verdicts(judged_matrix(spark, sf_dir).expand(columns, conditions=["baseline"]))
    forest = clean_full(spark, sf_dir).forest
    scored = attach(rows, forest, [*RUN, "user", "template"], how="inner", rows="n")
    return predictions(named_verdicts(scored, shares=CONTAMINATION_SWEEP).drop("template"))


def comparison_full(spark: SparkSession, sf_dir: str) -> tuple[MatrixVerdicts, ...]:
    """Five seeds, four conditions."""
    return clean_full(spark, sf_dir), disguised_full(spark, sf_dir)


def corpora_full(spark: SparkSession, sf_dir: str) -> tuple[MatrixVerdicts, ...]:
    """Five seeds, nine conditions."""
    return *comparison_full(spark, sf_dir), other_full(spark, sf_dir)

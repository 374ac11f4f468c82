"""One Spark query per operator of the survey."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import tables as t
from logwarden.config import CONTAMINATION_SWEEP, DEFAULTS
from logwarden.functions import text
from logwarden.functions.numbers import HOUR, draw
from logwarden.operators import assembly, camouflage, forest, injection, metrics, prompts, rules, techniques, triage
from logwarden.operators.asof import asof_join
from logwarden.operators.embed import embed_templates
from logwarden.operators.incidents import assign_incidents
from logwarden.operators.joins import attach
from logwarden.operators.quantiles import weighted_quantiles
from logwarden.operators.ranges import overlap_join
from logwarden.operators.ranking import rank_rows, tile_rows
from logwarden.operators.sessions import gap_sessions
from logwarden.operators.severity import highest_severity
from logwarden.operators.sketches import daily_sketches, estimates, merge_sketches
from logwarden.operators.travel import travel_lines
from logwarden.plans import evaluation
from logwarden.plans.evaluation import RUN
from logwarden.session import settle
from logwarden.sources import logs
from logwarden.sources import tables as files
from logwarden.streaming import rules as streams
from logwarden.streaming.incidents import IncidentStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STREAM_BATCHES = 10
INCIDENT_BATCHES = 4
RULE_DETECTORS = ("rules", "rules_travel", "travel_rule")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- text to events

@query
def flagship(spark, sf_dir):
    """Raw lines to travel verdicts and severity, counted per user."""
    judged = t.judged(spark, sf_dir)
    return judged.groupBy("user").agg(
        F.count("*").alias("events"),
        F.count_if("impossible_travel").alias("travel"),
        F.count_if("is_anomaly").alias("anomalies"),
        highest_severity(F.col("severity")).alias("worst"),
    )


@query
def format_lines(spark, sf_dir):
    return t.lines(spark, sf_dir)


@query
def text_roundtrip(spark, sf_dir):
    """Written as text files in order and scanned back with line numbers."""
    path = t.scratch(spark, "lines")
    logs.write_lines(t.lines(spark, sf_dir), path)
    return logs.read_lines(spark, path, across_files=True).select("line_number", "value")


@query
def parse_lines(spark, sf_dir):
    return logs.parse_lines(t.lines(spark, sf_dir), t.YEAR)


@query
def parsed_roundtrip(spark, sf_dir):
    path = t.scratch(spark, "parsed")
    files.write_parsed(t.parsed(spark, sf_dir), path)
    return files.read_parsed(spark, path)


@query
def rejected_lines(spark, sf_dir):
    """Prose is no log: every line of the documents goes through the parser's filter."""
    raw = t.table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("value"))
    return raw.groupBy("lang").agg(
        F.count("*").alias("lines"), F.count_if(~logs.is_log_line(F.col("value"))).alias("rejected")
    )


@query
def message_templates(spark, sf_dir):
    return t.parsed(spark, sf_dir).groupBy("template").agg(
        F.count("*").alias("events"), F.countDistinct("user").alias("users")
    )


@query
def successful_logins(spark, sf_dir):
    """Accepted logins per network of the first two octets."""
    logins = t.parsed(spark, sf_dir).filter(
        text.is_accepted_login(F.col("message")) & F.col("source_ip").isNotNull()
    )
    return logins.groupBy(text.subnet(F.col("source_ip")).alias("subnet")).agg(
        F.count("*").alias("logins"), F.countDistinct("user").alias("users")
    )


@query
def identities(spark, sf_dir):
    """Joinable identities and displayable fields of users and addresses."""
    rows = t.parsed(spark, sf_dir)
    return rows.groupBy(
        text.identity_of(F.col("user")).alias("identity"), text.field_of(F.col("user")).alias("field")
    ).agg(F.count("*").alias("events"), F.count(text.identity_of(F.col("source_ip"))).alias("with_address"))


# --- detectors

@query
def impossible_travel(spark, sf_dir):
    hits = travel_lines(t.parsed(spark, sf_dir))
    found = attach(t.parsed(spark, sf_dir), hits, ["line_number"], how="inner")
    return found.select("line_number", "timestamp", "user", "source_ip")


@query
def rule_brute_force(spark, sf_dir):
    return rules.brute_force_lines(t.parsed(spark, sf_dir))


@query
def rule_enumeration(spark, sf_dir):
    return rules.enumeration_lines(t.parsed(spark, sf_dir))


@query
def rule_privileged_command(spark, sf_dir):
    return rules.privileged_command_lines(t.parsed(spark, sf_dir))


@query
def rules_fired(spark, sf_dir):
    return rules.detect_by_rules(t.parsed(spark, sf_dir)).select("line_number", "rules_fired", "is_anomaly")


@query
def rule_counts(spark, sf_dir):
    return rules.rule_counts(rules.detect_by_rules(t.parsed(spark, sf_dir)))


@query
def streaming_rules(spark, sf_dir):
    """The log in ten files, one a batch, through the rules over a stream; a heartbeat ends it."""
    rows = t.parsed(spark, sf_dir).select("line_number", "timestamp", "user", "source_ip", "message")
    path, last = t.scratch(spark, "stream"), rows.agg(F.max("line_number")).first()[0] or 0
    for part in range(STREAM_BATCHES):
        mine = rows.filter(F.floor((F.col("line_number") - 1) * STREAM_BATCHES / max(last, 1)) == part)
        mine.coalesce(1).write.mode("append").parquet(f"{path}/in")
    beat = rows.agg((F.max("timestamp") + F.expr("interval 1 day")).alias("timestamp")).select(
        F.lit(0).cast("bigint").alias("line_number"), "timestamp", F.lit(None).cast("string").alias("user"),
        F.lit(None).cast("string").alias("source_ip"), F.lit("-- MARK --").alias("message"))
    beat.coalesce(1).write.mode("append").parquet(f"{path}/in")
    own = spark.newSession()  # the state keeps the number of partitions it begins with
    own.conf.set("spark.sql.shuffle.partitions", "4")
    log = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    findings = streams.streaming_rules(log)
    streams.start_rules(findings, f"{path}/out", f"{path}/state").awaitTermination()
    return streams.claimed_lines(rows, spark.read.schema(streams.FINDINGS).parquet(f"{path}/out"))


@query
def severity_tiers(spark, sf_dir):
    return t.judged(spark, sf_dir).select("line_number", "is_anomaly", "impossible_travel", "severity")


@query
def quantile_threshold(spark, sf_dir):
    """The contamination cut on a given score column: ``events.value`` by user."""
    rows = t.table(spark, sf_dir, "events").select("user_id", "value")
    cuts = weighted_quantiles(
        rows, ["user_id"], "value", F.lit(1), CONTAMINATION_SWEEP, F.floor(F.col("value") * 16)
    )
    return cuts.select("user_id", "share", F.bround("quantile", 6).alias("quantile"))


@query
def outlier_flags(spark, sf_dir):
    """Strictly below the cut is an outlier; a tie with the cut is not."""
    rows = t.table(spark, sf_dir, "events").select("user_id", "value")
    cuts = weighted_quantiles(rows, ["user_id"], "value", F.lit(1), [0.2], F.floor(F.col("value") * 16))
    return rows.join(cuts, "user_id").groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("value") < F.col("quantile")).alias("outliers")
    )


@query
def template_vectors(spark, sf_dir):
    vectors = embed_templates(t.parsed(spark, sf_dir).select("template"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select("template", F.size("embedding").alias("size"), F.bround(norm, 3).alias("squared_norm"))


@query
def forest_scores(spark, sf_dir):
    """Verdict per (user, template) by per-user forests with a global fallback."""
    return forest.score_templates(t.parsed(spark, sf_dir)).select(
        "user", "template", "n", F.bround("anomaly_score", 6).alias("anomaly_score"), "ml_anomaly"
    )


@query
def embedding_outliers(spark, sf_dir):
    """The same forests on given vectors: ``embeddings`` with the label as the key."""
    given = t.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("user"), F.col("vec_id").cast("string").alias("template"), "embedding"
    )
    pairs = settle(given.select("user", "template", F.lit(1).cast("bigint").alias("n")))
    vectors = settle(given.select("template", F.col("embedding").cast("array<float>").alias("embedding")))
    rows = settle(forest.population(pairs))
    grown = settle(forest.fit_forests(rows, vectors))
    scored = settle(forest.score_population(rows, vectors, grown))
    verdicts = forest.decide(pairs, scored, settle(forest.offsets(scored, [DEFAULTS.contamination])))
    return verdicts.select(
        F.col("user").alias("label"), F.col("template").alias("vec_id"),
        F.bround("anomaly_score", 6).alias("anomaly_score"), "ml_anomaly",
    )


@query
def scored_events(spark, sf_dir):
    return t.scored(spark, sf_dir).groupBy("user", "severity").agg(
        F.count("*").alias("events"), F.count_if("ml_anomaly").alias("ml_anomalies"),
        F.count_if("impossible_travel").alias("travel"),
    )


@query
def scored_incidents(spark, sf_dir):
    """Incidents of the full system."""
    tagged = settle(assign_incidents(t.scored(spark, sf_dir)))
    return assembly.incident_table(tagged).select("incident_id", "summary", "event_count", "severity", "notable")


# --- incidents

@query
def incident_assignment(spark, sf_dir):
    return assign_incidents(t.judged(spark, sf_dir)).select("line_number", "incident_id")


@query
def incident_assignment_by_user(spark, sf_dir):
    return assign_incidents(t.judged(spark, sf_dir), by_source_ip=False).select("line_number", "incident_id")


@query
def incident_insertion(spark, sf_dir):
    """Incidents built batch by batch, the batches mixed in time."""
    flagged = t.judged(spark, sf_dir).filter("is_anomaly").select("line_number", "timestamp", "user", "source_ip")
    store = IncidentStore(spark, t.scratch(spark, "store"))
    for batch in range(INCIDENT_BATCHES):
        store.add(flagged.filter(F.pmod(F.xxhash64("line_number"), F.lit(INCIDENT_BATCHES)) == batch), batch)
    return store.incidents(flagged)


@query
def incidents(spark, sf_dir):
    return t.incidents(spark, sf_dir).select(
        "incident_id", "summary", F.array_join("users", ",").alias("users"),
        F.array_join("source_ips", ",").alias("source_ips"), "start", "end", "event_count", "severity",
        F.array_join(F.transform("mitre_techniques", lambda m: m["technique_id"]), ",").alias("techniques"),
        "notable",
    )


@query
def incident_users(spark, sf_dir):
    return assembly.incident_members(t.tagged(spark, sf_dir), "user")


@query
def incident_events(spark, sf_dir):
    return assembly.incident_events(t.tagged(spark, sf_dir))


@query
def incident_records(spark, sf_dir):
    """Exported as JSON records and read back."""
    path = t.scratch(spark, "incidents")
    files.write_incidents(assembly.incident_records(t.incidents(spark, sf_dir)), path)
    return files.read_incidents(spark, path).select(
        "incident_id", "summary", F.array_join("users", ",").alias("users"), "start", "end", "event_count", "severity",
        F.array_join(F.transform("mitre_techniques", lambda m: m["technique_name"]), ",").alias("techniques"),
    )


@query
def incident_event_records(spark, sf_dir):
    """The events of all incidents as JSON records, read back."""
    path = t.scratch(spark, "incident-events")
    files.write_incident_events(assembly.incident_event_records(t.tagged(spark, sf_dir)), path)
    return files.read_incident_events(spark, path)


@query
def run_counters(spark, sf_dir):
    return assembly.run_counters(t.judged(spark, sf_dir), t.incidents(spark, sf_dir))


@query
def message_techniques(spark, sf_dir):
    return techniques.message_techniques(t.parsed(spark, sf_dir)).select(
        "line_number", "technique_id", "technique_name", "tactic"
    )


@query
def incident_signals(spark, sf_dir):
    return techniques.incident_signals(t.tagged(spark, sf_dir))


@query
def incident_techniques(spark, sf_dir):
    return techniques.incident_techniques(t.tagged(spark, sf_dir)).select(
        "incident_id", F.col("position").cast("bigint").alias("position"), "technique_id", "technique_name",
        "tactic", "evidence",
    )


@query
def incident_prompts(spark, sf_dir):
    return prompts.incident_prompts(t.tagged(spark, sf_dir), t.incidents(spark, sf_dir)).select(
        "incident_id", "summary_block", "events_block", "technique_block", "prompt"
    )


# --- triage

@query
def triage_board(spark, sf_dir):
    """The whole board with its place in triage order."""
    from logwarden.operators.ordering import number_rows
    from logwarden.operators.severity import severity_rank

    rows = t.incidents(spark, sf_dir).select("incident_id", "event_count", "severity")
    order = [F.desc("event_count"), F.desc(severity_rank(F.col("severity"))), "incident_id"]
    return number_rows(rows, order, "place")


@query
def triage_top(spark, sf_dir):
    return triage.triage_order(t.incidents(spark, sf_dir), limit=20).select("incident_id", "event_count", "severity")


@query
def triage_headline(spark, sf_dir):
    return triage.headline(t.incidents(spark, sf_dir))


@query
def triage_selection(spark, sf_dir):
    chosen = triage.select_incidents(
        t.incidents(spark, sf_dir), severities=("high", "medium"), user="u01", only_with_technique=True
    )
    return chosen.select("incident_id", "severity", "event_count")


@query
def user_facet(spark, sf_dir):
    return triage.user_facet(t.incidents(spark, sf_dir))


# --- scenarios and camouflage; one instance per scenario and user id

_ROW = ("seed", "scenario", "instance", "step", "ts", "process", "pid", "message", "user", "description")


@query
def scenario_targets(spark, sf_dir):
    return t.targets(spark, sf_dir)


@query
def inject_brute_force(spark, sf_dir):
    return injection.inject_brute_force(t.targets(spark, sf_dir)).select(*_ROW)


@query
def inject_travel(spark, sf_dir):
    return injection.inject_travel(t.targets(spark, sf_dir)).select(*_ROW)


@query
def inject_enumeration(spark, sf_dir):
    return injection.inject_enumeration(t.targets(spark, sf_dir)).select(*_ROW)


def _camouflaged(strategy: str) -> Query:
    def build(spark, sf_dir):
        attacks = injection.inject(t.targets(spark, sf_dir))
        return camouflage.camouflage(attacks, [strategy], users=t.USERS).select(*_ROW)

    build.__name__ = f"camouflage_{strategy}"
    return build


for _name in camouflage.STRATEGIES:
    query(_camouflaged(_name))


@query
def camouflage_combo(spark, sf_dir):
    attacks = injection.inject(t.targets(spark, sf_dir))
    return camouflage.camouflage(attacks, camouflage.REALISTIC_COMBO, users=t.USERS).select(*_ROW)


@query
def corpus_lines(spark, sf_dir):
    """Background and attacks merged and numbered, all as log lines."""
    plain = t.background(spark, sf_dir).withColumn("seed", F.lit(42).cast("bigint"))
    merged = injection.merge_corpus(plain, injection.inject(t.targets(spark, sf_dir)))
    return merged.select("line_number", "value", "scenario", "instance")


@query
def corpus_labels(spark, sf_dir):
    """Labels written as CSV and read back."""
    plain = t.background(spark, sf_dir).withColumn("seed", F.lit(42).cast("bigint"))
    merged = injection.merge_corpus(plain, injection.inject(t.targets(spark, sf_dir)))
    path = t.scratch(spark, "labels")
    files.write_labels(files.labels_of(merged), path)
    return files.read_labels(spark, path)


# --- evaluation over seeds and conditions

def _hits(spark, sf_dir) -> DataFrame:
    return metrics.label_hits(t.corpora_own(spark, sf_dir), t.corpora_labels(spark, sf_dir), RULE_DETECTORS, RUN)


def _scenario_counts(spark, sf_dir) -> DataFrame:
    return metrics.scenario_counts(metrics.instance_hits(_hits(spark, sf_dir), RULE_DETECTORS, RUN), RUN)


def _confusion(spark, sf_dir) -> DataFrame:
    flagged = metrics.flagged_lines(t.corpora_rules(spark, sf_dir), RULE_DETECTORS, RUN)
    return metrics.confusion_counts(_scenario_counts(spark, sf_dir), flagged, RUN)


@query
def scenario_counts(spark, sf_dir):
    return _scenario_counts(spark, sf_dir)


@query
def confusion_counts(spark, sf_dir):
    """Counts written and read back, so that rates never need a second detection."""
    path = t.scratch(spark, "counts")
    files.write_counts(_confusion(spark, sf_dir), path)
    return files.read_counts(spark, path)


@query
def run_rates(spark, sf_dir):
    return metrics.with_rates(_confusion(spark, sf_dir))


@query
def pooled_rates(spark, sf_dir):
    return metrics.pool_counts(_confusion(spark, sf_dir), ["condition", "detector"])


@query
def pooled_scenarios(spark, sf_dir):
    return metrics.pool_scenarios(_scenario_counts(spark, sf_dir), ["condition", "detector", "scenario"])


@query
def corpora_rule_counts(spark, sf_dir):
    return rules.rule_counts(t.corpora_rules(spark, sf_dir), ["condition"])


def _robust(spark, sf_dir) -> DataFrame:
    return metrics.robustness_counts(_hits(spark, sf_dir), detector="rules_travel")


def _robust_overall(spark, sf_dir) -> DataFrame:
    found = t.corpora_counts(spark, sf_dir)
    totals = found.groupBy(*RUN).agg(F.sum(F.when(F.col("rules_travel"), F.col("n")).otherwise(0)).alias("total_flagged_lines"))
    groups = t.corpora_parts(spark, sf_dir).groupBy(*RUN).agg(
        (F.max("incident_id") + 1).alias("incidents")
    )
    return metrics.robustness_overall(_robust(spark, sf_dir), totals.join(groups, list(RUN), "left"))


@query
def robustness_runs(spark, sf_dir):
    return _robust(spark, sf_dir)


@query
def robustness_overall(spark, sf_dir):
    return _robust_overall(spark, sf_dir)


@query
def robustness_pooled(spark, sf_dir):
    pooled = metrics.pool_robustness_overall(settle(_robust_overall(spark, sf_dir)))
    listed = F.array_join(F.transform("per_seed_instance_rate", lambda r: r.cast("string")), ",")
    return pooled.withColumn("per_seed_instance_rate", listed)


@query
def strategy_ranking(spark, sf_dir):
    pooled = metrics.pool_robustness(_robust(spark, sf_dir), ["condition"])
    ranked = metrics.rank_strategies(pooled, list(camouflage.ROBUSTNESS_CONDITIONS))
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


@query
def lossy_scenarios(spark, sf_dir):
    return metrics.lossy_scenarios(metrics.pool_robustness(_robust(spark, sf_dir)))


@query
def compensating_conditions(spark, sf_dir):
    return metrics.compensating_conditions(metrics.pool_robustness(_robust(spark, sf_dir)))


@query
def scenario_matrix(spark, sf_dir):
    pooled = metrics.pool_robustness(_robust(spark, sf_dir))
    return metrics.scenario_matrix(pooled, "line_detection_rate")


@query
def scenario_matrix_instances(spark, sf_dir):
    pooled = metrics.pool_robustness(_robust(spark, sf_dir))
    return metrics.scenario_matrix(pooled, "instance_detection_rate")


@query
def scenario_matrix_travel(spark, sf_dir):
    pooled = metrics.pool_robustness(_robust(spark, sf_dir))
    return metrics.scenario_matrix(pooled, "impossible_travel_hits")


@query
def side_by_side(spark, sf_dir):
    pooled = metrics.pool_counts(_confusion(spark, sf_dir), ["condition", "detector"])
    return metrics.side_by_side(pooled, ["condition"], ["recall", "f1"], "rules", "rules_travel")


@query
def incident_scenarios(spark, sf_dir):
    """Scenario of every incident of every run."""
    return triage.incident_scenarios(t.corpora_tagged(spark, sf_dir), t.corpora_labels(spark, sf_dir), RUN)


@query
def scenario_samples(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    return samples.select(*RUN, "scenario", "incident_id", "event_count", "severity")


@query
def uncovered_scenarios(spark, sf_dir):
    runs = t.corpora_labels(spark, sf_dir).select(*RUN)
    return triage.uncovered_scenarios(_samples(spark, sf_dir), runs)


def _samples(spark, sf_dir) -> DataFrame:
    tagged = t.corpora_tagged(spark, sf_dir)
    sizes = t.corpora_parts(spark, sf_dir).groupBy(*RUN, "incident_id").agg(
        F.sum("n").alias("event_count"), highest_severity(F.col("severity")).alias("severity")
    )
    table = sizes.withColumn("notable", assembly.notable(F.col("severity"), F.col("event_count")))
    return triage.pick_samples(
        table, triage.incident_scenarios(tagged, t.corpora_labels(spark, sf_dir), RUN), run=RUN
    )


@query
def scenario_levels(spark, sf_dir):
    """Counts per condition, detector and scenario and on every level above."""
    counts = metrics.pool_scenarios(_scenario_counts(spark, sf_dir), ["condition", "detector", "scenario"])
    return metrics.scenario_levels(counts, ["condition", "detector", "scenario"])


# --- joins in time, sessions, ranks, sketches

@query
def login_neighbours(spark, sf_dir):
    """Accepted logins with the failure of the same user before, after and nearest to each."""
    rows = t.parsed(spark, sf_dir).select("line_number", "timestamp", "user", "message")
    failed = rows.filter(text.is_failed_login(F.col("message")))
    found = rows.filter(text.is_accepted_login(F.col("message"))).select("line_number", "timestamp", "user")
    for direction in ("backward", "forward", "nearest"):
        found = asof_join(found, failed, ["user"], ["line_number"], order=["line_number"], direction=direction,
                          tolerance=HOUR, prefix=f"{direction}_")
    return found.drop("timestamp")


@query
def incident_logins(spark, sf_dir):
    """Logins of anyone that fall into the span of an incident."""
    spans = t.incidents(spark, sf_dir).select("incident_id", "start", "end")
    logins = t.parsed(spark, sf_dir).filter(text.is_accepted_login(F.col("message"))).select("timestamp", "user")
    pairs = overlap_join(spans, logins, ("start", "end"), ("timestamp", "timestamp"))
    return pairs.groupBy(F.col("left.incident_id").alias("incident_id")).agg(
        F.count("*").alias("logins"), F.countDistinct("right.user").alias("users"))


@query
def incident_overlaps(spark, sf_dir):
    """How many other incidents go on at the time of each."""
    spans = t.incidents(spark, sf_dir).select("incident_id", "start", "end")
    pairs = overlap_join(spans, spans, ("start", "end"), ("start", "end"))
    return pairs.groupBy(F.col("left.incident_id").alias("incident_id")).agg((F.count("*") - 1).alias("others"))


@query
def user_sessions(spark, sf_dir):
    """A failed login keeps a session open for five minutes, any other line for ten."""
    gap = F.when(text.is_failed_login(F.col("message")), 300).otherwise(600)
    return gap_sessions(t.parsed(spark, sf_dir), ["user"], gap)


@query
def value_ranks(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select("event_id", F.round("value", 0).alias("value"))
    ranked = rank_rows(rows, ["value"], salt_on="event_id")
    return tile_rows(ranked, ["value", "event_id"], 7, "tile")


@query
def sketched_values(spark, sf_dir):
    """Sketches by type and day, merged by type: exact counts, and whether estimates keep their bounds."""
    rows = t.table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    daily = settle(daily_sketches(rows, ["event_type"], F.col("ts").cast("date"), "value", "cents"))
    merged = settle(estimates(merge_sketches(daily, ["event_type"]), {"median": 0.5}))
    known = rows.join(F.broadcast(merged), "event_type")  # one row per type
    exact = known.groupBy("event_type").agg(
        F.first("rows").alias("rows"),
        F.countDistinct("value").alias("values"),
        F.first("distinct_estimate").alias("_values"),
        (F.count_if(F.col("cents") < F.col("median")) / F.count("cents")).alias("_below"),
        (F.count_if(F.col("cents") <= F.col("median")) / F.count("cents")).alias("_upto"),
    )
    return exact.select(
        "event_type", "rows", "values",
        (F.abs(F.col("_values") - F.col("values")) <= 0.08 * F.col("values")).alias("values_hold"),
        ((F.col("_below") <= 0.53) & (F.col("_upto") >= 0.47)).alias("median_holds"),
    )


# --- evaluation of the forest; no counterpart in SQL

def _full_scenarios(spark, sf_dir, found, detectors) -> DataFrame:
    """Counts per scenario; ``found`` are verdicts of some runs. Only lines that runs add carry labels."""
    own = _together([f.own for f in found], detectors, "line_number")
    runs = _together([f.counts for f in found]).distinct()
    labels = t.corpora_labels(spark, sf_dir).join(F.broadcast(runs), list(RUN))  # labels of the runs that are covered
    hits = metrics.label_hits(own, labels, detectors, RUN)
    return metrics.scenario_counts(metrics.instance_hits(hits, detectors, RUN), RUN)


def _together(tables, detectors=(), *more) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows.select(*RUN, *more, *detectors) for rows in tables])


def _full_counts(spark, sf_dir, found, detectors) -> DataFrame:
    per_scenario = _full_scenarios(spark, sf_dir, found, detectors)
    lines = _together([f.counts for f in found], detectors, "n")
    return metrics.confusion_counts(per_scenario, metrics.flagged_lines(lines, detectors, RUN, "n"), RUN)


def _compared(spark, sf_dir) -> DataFrame:
    counts = _full_counts(spark, sf_dir, t.comparison_full(spark, sf_dir), metrics.DETECTORS)
    return metrics.pool_counts(counts, ["condition", "detector"])


@query
def detector_comparison(spark, sf_dir):
    """Every detector under the four conditions the detectors are compared on."""
    return _compared(spark, sf_dir)


@query
def side_by_side_full(spark, sf_dir):
    """The fair rule detector beside the full system, by condition."""
    return metrics.side_by_side(_compared(spark, sf_dir), ["condition"], ["recall", "f1"], "rules_travel", "full")


@query
def side_by_side_scenarios(spark, sf_dir):
    """The fair rule detector beside the full system, by scenario of the clean runs."""
    counts = _full_scenarios(spark, sf_dir, [t.clean_full(spark, sf_dir)], ["rules_travel", "full"])
    pooled = metrics.pool_scenarios(counts, ["scenario", "detector"])
    return metrics.side_by_side(pooled, ["scenario"], ["line_detection_rate", "instance_detection_rate"], "rules_travel", "full")


def _sweep(spark, sf_dir) -> DataFrame:
    shares = evaluation.sweep_columns()
    counts = _full_counts(spark, sf_dir, [t.clean_full(spark, sf_dir)], list(shares))
    named = F.coalesce(*[F.when(F.col("detector") == c, F.lit(s)) for c, s in shares.items()])
    return metrics.pool_counts(counts, ["detector"]).withColumn("share", named)


@query
def contamination_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query
def sweep_choice(spark, sf_dir):
    return metrics.sweep_choice(_sweep(spark, sf_dir))


@query
def alert_volume(spark, sf_dir):
    """Lines and incidents per corpus, mean over the seeds, clean runs."""
    volumes = evaluation.alert_volume(t.clean_lines(spark, sf_dir))
    return metrics.mean_volume(
        volumes, ["log_lines", "rule_incidents", "rule_incidents_also_full", "full_incidents"], ["condition"]
    )


@query
def full_robustness(spark, sf_dir):
    detectors = ("full", "travel_rule")
    own = _together([f.own for f in t.corpora_full(spark, sf_dir)], detectors, "line_number")
    hits = metrics.label_hits(own, t.corpora_labels(spark, sf_dir), detectors, RUN)
    return metrics.pool_robustness(metrics.robustness_counts(hits))

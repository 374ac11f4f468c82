import pytest
from pyspark.sql import functions as F

from logwarden.config import Settings
from logwarden.functions import text
from logwarden.operators import camouflage, metrics
from logwarden.operators.injection import inject, merge_corpus, plan_targets
from logwarden.operators.rules import detect_by_rules
from logwarden.operators.travel import travel_lines
from logwarden.plans.detection import detect
from logwarden.plans.evaluation import RUN, alert_volume, build_corpora, detect_all, sweep_columns
from logwarden.session import settle
from logwarden.sources.logs import parse_lines
from logwarden.sources.tables import labels_of, read_counts, read_labels, read_parsed, write_counts, write_labels, write_parsed

SEEDS = [1, 2]
SETTINGS = Settings(trees=10)


@pytest.fixture(scope="module")
def attacks(spark):
    return settle(inject(plan_targets(spark, SEEDS)))


@pytest.fixture(scope="module")
def background(spark):
    """A calm log: one login per account and hour, from home."""
    return spark.range(600).select(
        F.timestamp_add("MINUTE", F.col("id") * 12, F.lit("2026-07-14").cast("timestamp_ntz")).alias("ts"),
        F.lit("sshd").alias("process"), (F.col("id") + 1).cast("int").alias("pid"), F.col("id").cast("int").alias("step"),
        F.concat(F.lit("pam_unix(sshd:session): session opened for user "),
                 F.element_at(F.array(*map(F.lit, ["alice", "bob", "carol"])), (F.col("id") % 3 + 1).cast("int")),
                 F.lit(" by (uid=0)")).alias("message"))


def per_instance(df):
    return {tuple(r)[:3]: r for r in df.groupBy(*camouflage.INSTANCE).agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()}


def test_injection_shapes(attacks):
    sizes = {k: r["n"] for k, r in per_instance(attacks).items()}
    assert len(sizes) == 2 * 9
    assert all({"A": n in (6, 7, 8), "B": n == 2, "C": n in (6, 7, 8)}[s] for (_, s, _), n in sizes.items())
    assert attacks.filter("scenario = 'C'").groupBy(*camouflage.INSTANCE).agg(
        (F.countDistinct("user") == F.count("*")).alias("ok")).filter("not ok").count() == 0
    events = attacks.withColumn("found", text.user_of(F.col("message")))
    assert events.filter("found != user").count() == 0


def test_clean_attacks_are_seen_by_rules_and_travel(attacks, background):
    plain = background.withColumn("seed", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    corpus = settle(merge_corpus(plain, attacks))
    events = parse_lines(corpus.select("seed", "line_number", "value"), 2026)
    assert events.count() == corpus.count()
    joined = corpus.join(detect_by_rules(events, run=["seed"]).select("seed", "line_number", "is_anomaly"), ["seed", "line_number"])
    seen = joined.filter("scenario in ('A', 'C')").groupBy(*camouflage.INSTANCE).agg(F.bool_or("is_anomaly").alias("hit"))
    assert seen.filter("not hit").count() == 0
    travel = travel_lines(events, run=["seed"]).join(corpus, ["seed", "line_number"])
    assert travel.filter("scenario = 'B' and step = 1").count() == 6


def test_temporal_and_slow(attacks):
    for name, (low, high) in (("temporal", (8, 20)), ("slow", (35, 90))):
        spread = camouflage.camouflage(attacks, [name])
        before, after = per_instance(attacks), per_instance(spread)
        assert all(after[k]["lo"] == r["lo"] and after[k]["n"] == r["n"] for k, r in before.items())
        rows = spread.select(*camouflage.INSTANCE, "ts").collect()
        by_key = {}
        for r in rows:
            by_key.setdefault(tuple(r)[:3], []).append(r["ts"])
        gaps = [(b - a).total_seconds() / 60 for ts in by_key.values() for a, b in zip(sorted(ts), sorted(ts)[1:])]
        assert all(g == int(g) and low <= g <= high for g in gaps)


def test_slow_wins_over_temporal(attacks):
    both = camouflage.camouflage(attacks, ["temporal", "slow"])
    assert both.exceptAll(camouflage.camouflage(attacks, ["slow"])).count() == 0


def test_volume(attacks):
    kept = camouflage.camouflage(attacks, ["volume"])
    before, after = per_instance(attacks), per_instance(kept)
    assert all(after[k]["lo"] == r["lo"] and after[k]["hi"] == r["hi"] and after[k]["n"] <= r["n"] for k, r in before.items())
    assert all(after[k]["n"] == 2 for k in before if k[1] == "B")
    assert kept.count() < attacks.count()


def test_noise(attacks):
    noisy = camouflage.camouflage(attacks, ["noise", "slow"])
    spread = camouflage.camouflage(attacks, ["slow"])
    extra = noisy.filter("scenario is null")
    assert extra.count() == sum(int(r["n"] * 1.5) for r in per_instance(spread).values())
    assert extra.filter("user is not null or instance is not null or message like '%{%'").count() == 0
    assert noisy.filter("scenario is not null").exceptAll(spread).count() == 0


def test_ip_rotate(attacks):
    turned = camouflage.camouflage(attacks, ["ip_rotate"]).withColumn("ip", text.ip_of(F.col("message")))
    ips = [r["ip"] for r in turned.filter("ip is not null").collect()]
    assert {ip.rsplit(".", 1)[0] + "." for ip in ips} <= set(camouflage.FOREIGN_NETWORKS)
    assert all(2 <= int(ip.rsplit(".", 1)[1]) <= 250 for ip in ips)
    assert len(ips) == attacks.filter(text.ip_of(F.col("message")).isNotNull()).count()


def test_rephrase_and_mimicry(attacks):
    said = camouflage.camouflage(attacks, ["rephrase"])
    assert said.filter(F.col("message").rlike("Failed password|Accepted password|/bin/su root|added new user")).count() == 0
    named = said.filter(F.col("message").contains(" from "))
    assert named.filter((text.user_of(F.col("message")) != F.col("user")) | text.ip_of(F.col("message")).isNull()).count() == 0
    shaped = camouflage.camouflage(attacks, ["mimicry"]).filter("message like 'pam_unix(sudo%'").collect()
    assert len(shaped) == attacks.filter("process in ('sudo', 'usermod')").count()
    assert {r["message"].split("user ")[1].split(" ")[0] for r in shaped} == {"root", "backdoor01", "backdoor02", "backdoor03"}


def test_upper_case_phrase_is_found_but_kept(spark):
    rows = spark.sql("select 1L seed, 'A' scenario, 1 instance, 0 step, 'FAILED PASSWORD for x; added new user' message")
    assert camouflage.rephrase(rows).first()["message"] == "FAILED PASSWORD for x; added new user"


def test_draws_do_not_depend_on_partitions(spark, attacks):
    one = camouflage.camouflage(attacks.coalesce(1), camouflage.REALISTIC_COMBO)
    many = camouflage.camouflage(attacks.repartition(7), camouflage.REALISTIC_COMBO)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()


def test_unknown_strategy(attacks):
    with pytest.raises(ValueError):
        camouflage.camouflage(attacks, ["invisible"])


def test_metrics_unit_case(spark):
    events = spark.createDataFrame([(i, i in (2, 5)) for i in range(1, 7)], "line_number BIGINT, d BOOLEAN")
    labels = spark.createDataFrame([(1, "A", 1), (2, "A", 1), (3, "B", 1), (99, "B", 2)], "line_number BIGINT, scenario STRING, instance INT")
    known = labels.filter("line_number < 50")
    hits = metrics.label_hits(events, known, ["d"])
    per = metrics.scenario_counts(metrics.instance_hits(hits, ["d"]))
    row = metrics.with_rates(metrics.confusion_counts(per, metrics.flagged_lines(events, ["d"]))).first().asDict()
    assert row == {"detector": "d", "tp": 1, "fp": 1, "fn": 2, "flagged": 2, "attack_lines": 3, "instances": 2,
                   "instances_detected": 1, "precision": 0.5, "recall": 0.333, "f1": 0.4, "instance_detection_rate": 0.5}
    assert metrics.label_hits(events, labels, ["d"]).filter("line_number = 99").first()["d"] is False
    none = metrics.with_rates(spark.createDataFrame([(0,) * 7], ", ".join(f"{c} BIGINT" for c in metrics.LINE_COUNTS))).first()
    assert (none["precision"], none["recall"], none["f1"], none["instance_detection_rate"]) == (0.0, 0.0, 0.0, 0.0)


def test_ranking_and_losses(spark):
    rows = [("baseline", "A", 10, 10, 2, 2, 0), ("baseline", "B", 4, 2, 2, 2, 2), ("slow", "A", 10, 8, 2, 2, 0),
            ("slow", "B", 4, 1, 2, 1, 1), ("noise", "A", 10, 9, 2, 2, 0), ("noise", "B", 4, 2, 2, 2, 1)]
    counts = spark.createDataFrame(rows, "condition STRING, scenario STRING, attack_lines BIGINT, lines_detected BIGINT, "
                                         "instances BIGINT, instances_detected BIGINT, impossible_travel_hits BIGINT")
    pooled = metrics.pool_robustness(counts)
    assert [(r["scenario"], r["condition"]) for r in metrics.lossy_scenarios(pooled).collect()] == [("B", "slow")]
    over = {(r["scenario"], r["condition"]) for r in metrics.compensating_conditions(pooled).collect()}
    assert over == {("B", "noise")}
    two = pooled.withColumn("instance_detection_rate", F.when(F.col("condition") == "slow", 0.1).otherwise(F.col("instance_detection_rate")))
    assert metrics.compensating_conditions(two).count() == 0
    ranked = metrics.rank_strategies(metrics.pool_robustness(counts, ["condition"]), ["baseline", "slow", "noise"])
    assert [r["condition"] for r in ranked.orderBy("rank").collect()] == ["slow", "noise"]
    wide = {r["condition"]: r for r in metrics.scenario_matrix(pooled, "line_detection_rate").collect()}
    assert wide["slow"]["A"] == 0.8 and wide["slow"]["C"] is None


def test_sweep_choice(spark):
    rows = [(0.05, 0.35, 0.9, 100), (0.10, 0.44, 1.0, 300), (0.15, 0.44, 1.0, 450), (0.20, 0.43, 1.0, 700)]
    table = spark.createDataFrame(rows, "share DOUBLE, f1 DOUBLE, instance_detection_rate DOUBLE, flagged BIGINT")
    row = metrics.sweep_choice(table).first()
    assert (row["best_f1_share"], row["cheapest_complete_share"], row["noise_ratio"]) == (0.10, 0.10, 2.3)
    assert metrics.sweep_choice(table.filter("share < 0.1")).first()["cheapest_complete_share"] is None
    none = metrics.sweep_choice(table.filter("share in (0.05, 0.2)").withColumn("instance_detection_rate", F.lit(0.9))).first()
    late = metrics.sweep_choice(table.filter("share in (0.05, 0.2)")).first()
    assert (none["noise_ratio"], late["noise_ratio"], late["cheapest_complete_share"]) == (None, None, 0.2)


@pytest.mark.parametrize(("instance", "name"), [(7, "backdoor07"), (99, "backdoor99"), (100, "backdoor100"), (1000, "backdoor1000")])
def test_numbers_are_padded_and_never_cut(spark, instance, name):
    target = spark.sql(f"select 1L seed, 'A' scenario, {instance} instance, 'bob' user, '10.0.1.' home, date'2026-07-14' day")
    assert inject(target).filter(F.col("message").contains(f"'{name}'")).count() == 1


def test_runs_without_incidents_stay(spark):
    counts = spark.createDataFrame([(1, "c", "A", 4, 0, 2, 0), (2, "c", "A", 4, 3, 2, 2)],
        "seed BIGINT, condition STRING, scenario STRING, attack_lines BIGINT, lines_detected BIGINT, instances BIGINT, instances_detected BIGINT")
    totals = spark.createDataFrame([(2, "c", 3, 1)], "seed BIGINT, condition STRING, total_flagged_lines BIGINT, incidents BIGINT")
    found = {r["seed"]: (r["total_flagged_lines"], r["incidents"]) for r in metrics.robustness_overall(counts, totals).collect()}
    assert found == {1: (0, 0), 2: (3, 1)}


def test_run_matrix(spark, background):
    shares = (0.1, 0.2)
    conditions = {"clean": [], "realistic-combo": camouflage.REALISTIC_COMBO}
    corpus = settle(build_corpora(background, plan_targets(spark, SEEDS), SEEDS, conditions))
    parsed = settle(parse_lines(corpus.select(*RUN, "line_number", "value"), 2026))
    found = settle(metrics.predictions(detect_all(parsed, SETTINGS, shares)))
    assert found.count() == corpus.count()
    assert found.filter("full != full_20 or (full_10 and not full_20)").count() == 0
    clean = found.filter("seed = 2 and condition = 'clean'")
    alone = parsed.filter("seed = 2 and condition = 'clean'").drop(*RUN)
    single = detect(alone, SETTINGS)
    assert {r[0] for r in clean.filter("impossible_travel").select("line_number").collect()} == {
        r[0] for r in single.scored.filter("impossible_travel").select("line_number").collect()}
    labels = labels_of(corpus)
    columns = [*metrics.DETECTORS, *sweep_columns(shares)]
    hits = metrics.label_hits(found, labels, columns, RUN)
    counts = metrics.confusion_counts(metrics.scenario_counts(metrics.instance_hits(hits, columns, RUN), RUN),
                                      metrics.flagged_lines(found, columns, RUN), RUN)
    rates = {(r["condition"], r["detector"]): r for r in metrics.pool_counts(counts, ["condition", "detector"]).collect()}
    assert len(rates) == 2 * len(columns)
    assert rates["clean", "rules_travel"]["instance_detection_rate"] == 1.0
    assert rates["realistic-combo", "rules_travel"]["recall"] < rates["clean", "rules_travel"]["recall"]
    volume = alert_volume(found, run=RUN).collect()
    assert len(volume) == 4 and all(r["rule_incidents_also_full"] <= r["rule_incidents"] for r in volume)
    mean = metrics.mean_volume(alert_volume(found.filter("condition = 'clean'"), run=RUN), ["full_incidents"]).first()
    total = [r["full_incidents"] for r in volume if r["condition"] == "clean"]
    assert mean["full_incidents"] == sum(total) // 2


def test_sinks(spark, attacks, background, tmp_path):
    corpus = merge_corpus(background.withColumn("seed", F.lit(1).cast("bigint")), attacks.filter("seed = 1"))
    labels = labels_of(corpus).drop("seed")
    write_labels(labels, str(tmp_path / "labels"))
    assert read_labels(spark, str(tmp_path / "labels")).exceptAll(labels).count() == 0
    parsed = parse_lines(corpus.select("line_number", "value"), 2026)
    for kind in ("parquet", "csv"):
        write_parsed(parsed, str(tmp_path / kind), kind)
        assert read_parsed(spark, str(tmp_path / kind), kind).exceptAll(parsed).count() == 0
    write_counts(labels.groupBy("scenario").count(), str(tmp_path / "counts"))
    assert read_counts(spark, str(tmp_path / "counts")).count() == 3

"""Rules and incidents over growing logs against the batch operators."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import brute_force_pairwise, enumeration_pairwise, lines_of, random_log, travel_pairwise
from logwarden.config import DEFAULTS, Settings
from logwarden.operators import rules
from logwarden.operators.incidents import assign_incidents
from logwarden.operators.travel import travel_lines
from logwarden.streaming.incidents import IncidentStore
from logwarden.streaming.rules import (
    burst_verdicts, claimed_lines, fan_out_verdicts, late_lines, start_rules, streaming_rules,
)

MINUTE = 60_000_000


@pytest.fixture(scope="module")
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def feed(events, folder, parts):
    """One file for each list of lines, in this order, and a heartbeat at the end if asked."""
    for lines in parts:
        events.filter(F.col("line_number").isin(lines)).coalesce(1).write.mode("append").parquet(folder)


def beat(events, folder, at="2027-01-01 00:00:00"):
    row = events.sparkSession.createDataFrame([(0, datetime.fromisoformat(at), None, None, "")], events.schema)
    row.coalesce(1).write.mode("append").parquet(folder)


def run(own, events, root, **options):
    log = own.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = start_rules(streaming_rules(log, **options), f"{root}/out", f"{root}/state")
    query.awaitTermination()
    return events.sparkSession.read.parquet(f"{root}/out")


def by_rule(events, findings):
    out = defaultdict(list)
    for r in claimed_lines(events, findings).collect():
        out[r.rule].append(r.line_number)
    return {k: sorted(v) for k, v in out.items()}


def test_batches_of_a_disordered_log_restarted_halfway_equal_the_batch_rules(spark, own, events_of, tmp_path):
    rows = random_log(240, seed=4)
    events = events_of(rows)
    dated = sorted((ts, i) for i, (ts, *_) in enumerate(rows, 1) if ts)
    # up to 30 minutes of disorder: neighbours in time are dealt to two files at random
    draw, parts = random.Random(1), [[] for _ in range(7)]
    for k, (_, line) in enumerate(dated):
        parts[min(6, k * 6 // len(dated) + draw.randrange(2))].append(line)
    feed(events, f"{tmp_path}/in", parts[:3])
    run(own, events, tmp_path, delay="90 minutes")
    feed(events, f"{tmp_path}/in", parts[3:])
    beat(events, f"{tmp_path}/in")
    findings = run(own, events, tmp_path, delay="90 minutes")
    assert late_lines(findings).count() == 0
    got = by_rule(events, findings)
    assert got.pop("privileged_command", []) == lines_of(rules.privileged_command_lines(events))
    want = {"brute_force": brute_force_pairwise(rows), "enumeration": enumeration_pairwise(rows), "impossible_travel": travel_pairwise(rows)}
    assert got == {k: v for k, v in want.items() if v}


def test_late_rows_go_aside_and_the_rest_is_judged_without_them(spark, own, events_of, tmp_path):
    def burst(hour, minute, n):
        return [(f"2026-07-14 {hour}:{minute:02d}:{i:02d}", "a", "10.0.0.1", "Failed password for a") for i in range(n)]

    rows = burst(10, 0, 4) + burst(12, 0, 2) + burst(10, 1, 3) + burst(12, 1, 2)
    events = events_of(rows)
    feed(events, f"{tmp_path}/in", [[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11]])
    beat(events, f"{tmp_path}/in")
    findings = run(own, events, tmp_path, delay="5 minutes")
    late = {(r.rule, r.line_number) for r in late_lines(findings).collect()}
    assert late == {(rule, n) for rule in ("brute_force", "enumeration") for n in (7, 8, 9)}
    in_time = events.filter(~F.col("line_number").isin(7, 8, 9))
    assert by_rule(events, findings) == {"brute_force": lines_of(rules.brute_force_lines(in_time))}
    assert lines_of(rules.brute_force_lines(in_time)) == [1, 2, 3, 4, 5, 6, 10, 11]


def test_verdicts_match_pairwise_definitions():
    draw = np.random.default_rng(8)
    for _ in range(300):
        n, window, least = int(draw.integers(1, 30)), 5 * MINUTE, int(draw.integers(1, 5))
        at = np.unique(draw.integers(0, 60, n)) * MINUTE
        fails, oks = draw.integers(0, 3, len(at)), draw.integers(0, 2, len(at))
        burst, follow = burst_verdicts(at, fails, oks, window, least)
        spans = []
        for i, a in enumerate(at):
            inside = [j for j in range(len(at)) if a <= at[j] <= a + window and fails[j]]
            if fails[i] and sum(fails[inside]) >= least:
                spans.append((a, max(at[j] for j in inside)))
        assert burst.tolist() == [bool(f) and any(s <= a <= s + window for s, _ in spans) for a, f in zip(at, fails)]
        assert follow.tolist() == [bool(o) and any(e <= a <= e + window for _, e in spans) for a, o in zip(at, oks)]
        names = [set(draw.choice(list("abcdef"), int(draw.integers(0, 4))).tolist()) for _ in at]
        opens = [a for i, a in enumerate(at) if len(set().union(*(names[j] for j in range(i, len(at)) if at[j] <= a + window))) >= least]
        assert fan_out_verdicts(at.tolist(), names, window, least) == [any(o <= a <= o + window for o in opens) for a in at]


def groups(df):
    out = defaultdict(list)
    for r in df.select("line_number", "incident_id").collect():
        out[r.incident_id].append(r.line_number)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(
    ("split", "by_source_ip", "settings"),
    [("in order", True, DEFAULTS), ("backwards", True, DEFAULTS), ("mixed", True, Settings(broadcast_rows=50, heavy_key_rows=5)),
     ("mixed", False, DEFAULTS)])
def test_any_split_of_the_log_gives_the_incidents_of_one_run(spark, events_of, tmp_path, split, by_source_ip, settings):
    rows = random_log(150, seed=6, minutes=3000, users=("a", "b", "c", "d", "e", "unknown"))
    events = events_of(rows).withColumn("is_anomaly", F.lit(True))
    number = {"in order": F.floor(F.col("line_number") / 51), "mixed": F.pmod(F.xxhash64("line_number"), F.lit(3)),
              "backwards": F.floor((F.lit(152) - F.col("line_number")) / 51)}[split]
    store = IncidentStore(spark, f"{tmp_path}/store", settings, by_source_ip)
    for batch in range(3):
        store.add(events.filter(number == batch), batch)
    store.add(events.filter(number == 2), 2)  # a batch that is repeated changes nothing
    want = groups(assign_incidents(events, by_source_ip=by_source_ip))
    assert groups(store.incidents(events)) == want and len(want) > 3


def test_a_batch_reads_only_what_it_comes_near(spark, events_of, tmp_path):
    days = 12
    rows = [((datetime(2026, 7, 1) + timedelta(days=d, minutes=40 * k)).isoformat(), f"u{k % 5}", f"10.0.0.{k % 7}", "m")
            for d in range(days) for k in range(30)]
    events = events_of(rows)
    store = IncidentStore(spark, f"{tmp_path}/store")
    first = store.add(events, 0)
    assert first.read_cells == 0 and first.new_cells == 2 * len(rows)
    more = events_of([(datetime(2026, 7, 5, 0, 10).isoformat(), "u0", "10.0.0.0", "m")]).withColumn("line_number", F.lit(10_000).cast("bigint"))
    second = store.add(more, 1)
    assert second.new_cells == 2 and 0 < second.read_cells <= 6
    every = events.unionByName(more).withColumn("is_anomaly", F.lit(True))
    assert groups(store.incidents(every)) == groups(assign_incidents(every))


def test_streamed_batches_fill_a_store(spark, own, events_of, tmp_path):
    rows = random_log(60, seed=2, minutes=600)
    events = events_of(rows)
    feed(events, f"{tmp_path}/in", [list(range(1, 31)), list(range(31, 61))])
    store = IncidentStore(spark, f"{tmp_path}/store")
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    log.writeStream.foreachBatch(lambda df, number: store.add(df, number) and None).option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want = assign_incidents(events.withColumn("is_anomaly", F.lit(True)))
    assert groups(store.incidents(events)) == groups(want)


def test_empty_batches(spark, events_of, tmp_path):
    store = IncidentStore(spark, f"{tmp_path}/store")
    none = events_of([])
    assert store.add(none, 0).new_cells == 0 and store.incidents(none).count() == 0
    assert travel_lines(none).count() == 0

"""Runs over a shared background against the same lines judged run by run."""

import random

import numpy as np
from pyspark.sql import functions as F

from logwarden.plans import matrix as plans
from logwarden.plans.detection import flag_lines
from logwarden.config import Settings
from logwarden.operators import metrics
from logwarden.operators.forest import average_path, grow_tree, path_lengths
from logwarden.plans.evaluation import CORPUS, detect_all, detect_matrix, parse_matrix, run_incidents, sweep_columns, tag_labelled
from logwarden.operators.incidents import assign_incidents
from logwarden.operators.injection import merge_corpus
from logwarden.session import settle
from logwarden.sources.logs import format_line, parse_lines

ROW = "ts timestamp_ntz, process string, pid int, message string, step int"
LABELS = "scenario string, instance int, user string, description string"


def _message(draw):
    user, ip = draw.choice(["ann", "bob", "cy", "dee"]), f"10.{draw.randrange(3)}.0.{draw.randrange(2)}"
    return draw.choice([f"Failed password for {user} from {ip} port 1 ssh2", f"Accepted password for {user} from {ip} port 1 ssh2",
                        f"user={user} : COMMAND=/bin/su root", "(root) CMD (x)"])


def _rows(spark, n, seed, runs=None):
    import datetime

    draw = random.Random(seed)
    start = datetime.datetime(2026, 7, 14)
    rows = []
    for i in range(n):
        at = start + datetime.timedelta(seconds=draw.randrange(5 * 3600) // 20 * 20)
        row = (at if draw.random() > 0.01 else None, "sshd", i % 7, _message(draw) if draw.random() > 0.02 else "odd\tline", i)
        rows.append(row if runs is None else (*draw.choice(runs), *row, draw.choice(["A", "B", None]), i % 3, "ann", "d"))
    return spark.createDataFrame(rows, ROW if runs is None else f"seed bigint, condition string, {ROW}, {LABELS}")


def test_shared_background_equals_lines_of_every_run(spark):
    runs = [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    background = _rows(spark, 600, 1)
    attacks = _rows(spark, 40, 2, runs[:3])  # the last run adds nothing
    pairs = spark.createDataFrame(runs, "seed bigint, condition string")
    plain = settle(merge_corpus(background.crossJoin(F.broadcast(pairs)), attacks, plans.RUN))

    found = plans.lay_out(background, attacks, runs).each(lambda rows: rows.withColumn("value", format_line()))
    columns = [*plans.RUN, "line_number", *CORPUS]
    assert sorted(map(str, found.expand(CORPUS).select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))

    parsed = parse_lines(plain.select(*plans.RUN, "line_number", "value"), 2026)
    judged = [*plans.RUN, "line_number", "user", "message", "rules_fired", "impossible_travel"]
    expected = flag_lines(parsed, parsed, run=plans.RUN).select(*judged).collect()
    shared = plans.judge(parse_matrix(found, 2026))
    got = plans.with_verdicts(shared.expand(["user", "message"])).select(*judged).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert len({(r.rules_fired, r.impossible_travel) for r in expected}) > 3
    # verdicts of the background change near the rows of a run, and are undone as well as added
    assert shared.shared.filter("_flips is not null").count() > 5
    part = plans.with_verdicts(shared.expand(["user", "message"], conditions=["y"])).select(*judged).collect()
    assert sorted(map(str, part)) == sorted(str(r) for r in expected if r.condition == "y")


def test_detectors_of_runs_without_their_lines(spark):
    runs = [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    shares, settings = (0.1, 0.2), Settings(trees=8)
    found = plans.lay_out(_rows(spark, 400, 3), _rows(spark, 40, 4, runs[:3]), runs).each(
        lambda rows: rows.withColumn("value", format_line()))
    judged = plans.judge(parse_matrix(found, 2026))
    detectors = [*metrics.DETECTORS, *sweep_columns(shares)]
    for conditions in (None, ["y"]):
        lines = plans.with_verdicts(judged.expand(["timestamp", "user", "source_ip", "template"], conditions=conditions))
        every = settle(metrics.predictions(detect_all(settle(lines), settings, shares, flagged=True)))
        got = detect_matrix(judged, settings, shares, conditions)
        flagged = [metrics.flagged_lines(every, detectors, plans.RUN), metrics.flagged_lines(got.counts, detectors, plans.RUN, "n")]
        assert sorted(map(str, flagged[0].collect())) == sorted(map(str, flagged[1].collect()))
        assert got.counts.agg(F.sum("n")).first()[0] == every.count()
        key = [*plans.RUN, "line_number"]
        added = judged.own.select(*key)
        assert sorted(map(str, every.join(added, key).select(*key, *detectors).collect())) == sorted(
            map(str, got.own.select(*key, *detectors).collect()))
        # the background's lines are in no table of the verdicts, in no run
        assert got.counts.count() < 100 and got.own.count() <= judged.own.count()


def test_incidents_of_runs_without_their_lines(spark, monkeypatch):
    runs = [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    message = F.when(F.col("step") % 40 == 0, "COMMAND=/bin/su root").otherwise(F.col("message"))  # of nobody
    spread = F.col("ts") + F.make_interval(days=F.col("step") % 4)
    odd = {"message": message, "ts": spread}
    attacks = _rows(spark, 60, 6, runs[:3]).withColumns(odd)  # the last run adds nothing
    found = plans.lay_out(_rows(spark, 500, 5).withColumns(odd), attacks, runs).each(
        lambda rows: rows.withColumn("value", format_line()))
    judged = plans.judge(parse_matrix(found, 2026))
    lines = settle(metrics.predictions(plans.with_verdicts(judged.expand(["timestamp", "user", "source_ip"]))))
    every = settle(assign_incidents(lines, run=plans.RUN, flag="rules_travel"))
    assert every.filter("user = 'unknown' and source_ip is null").count() and judged.by_verdicts()[1].shared.count()

    expanded, expand = [], plans.RunMatrix.expand

    def counted(self, *args, **kwargs):
        expanded.append(self.shared.count())
        return expand(self, *args, **kwargs)

    monkeypatch.setattr(plans.RunMatrix, "expand", counted)
    got = run_incidents(judged)
    key = [*plans.RUN, "incident_id"]
    parts = got.parts([*key, "_rows", "_severe"]).groupBy(*key).agg(F.sum("_rows").alias("n"), F.sum("_severe").alias("t"))
    assert sorted(map(str, parts.collect())) == sorted(map(str, every.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if("impossible_travel").alias("t")).collect()))
    assert parts.count() > 40

    labels = lines.filter(F.col("line_number") % 7 == 0).select(*plans.RUN, "timestamp", "user")
    tagged = [*key, "line_number", "timestamp", "user", "impossible_travel"]
    near = every.join(labels.distinct(), [*plans.RUN, "timestamp", "user"], "left_semi").select(*tagged)
    few = tag_labelled(judged, got, labels).select(*tagged)
    assert sorted(map(str, few.collect())) == sorted(map(str, near.collect())) and 0 < near.count() < every.count()
    # the lines of the background are not put together for every run
    assert expanded[0] == judged.by_verdicts()[1].shared.count() < 100


def test_trees_are_walked_together():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 3, (30, 12)).astype(float)
    x[:, 4] = 1.0
    trees = [grow_tree(x[at], np.full(20, 3), draw) for at in (draw.permutation(30)[:20] for _ in range(9))]
    assert all(4 not in t[0] for t in trees) and max(len(t[0]) for t in trees) > 10

    def walk(row, feature, threshold, left, right, path):
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] <= threshold[at] else right[at]
        return path[at]

    assert path_lengths(x, trees).tolist() == [[walk(row, *t) for row in x] for t in trees]
    alone = grow_tree(x[:1], np.array([5]), draw)
    assert alone[0] == [-1] and alone[4] == [float(average_path(5))]

"""As-of join, range join and sessions against their definitions, with a user who has about half of all rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import TINY, parsed_rows, random_log
from logwarden.config import DEFAULTS
from logwarden.operators.asof import asof_join
from logwarden.operators.ranges import overlap_join
from logwarden.operators.sessions import gap_sessions, stream_sessions

HOUR = timedelta(hours=1)
BOTH = pytest.mark.parametrize("settings", [DEFAULTS, TINY])


def nearest_of(rows, direction, tolerance):
    """{line of an accepted login: line of the failure it meets}"""
    logins = [r for r in rows if "accepted" in r[4]]
    failed = [r for r in rows if "failed" in r[4] and r[1] and r[2]]
    out = {}
    for line, at, user, *_ in logins:
        same = [(f[1], f[0]) for f in failed if at and f[2] == user]
        back = max((f for f in same if f[0] <= at), default=None)
        ahead = min((f for f in same if f[0] >= at), default=None)
        met = {"backward": back, "forward": ahead}.get(direction)
        if direction == "nearest":
            both = [f for f in (back, ahead) if f]
            met = min(both, key=lambda f: abs(f[0] - at)) if both else None
        out[line] = met[1] if met and (tolerance is None or abs(met[0] - at) <= tolerance) else None
    return out


@BOTH
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("minutes", [None, 2])
def test_asof_matches_its_definition(spark, events_of, settings, direction, minutes):
    rows = random_log(150, 7, minutes=600)
    rows[3], rows[40] = (rows[3][0], None, *rows[3][2:]), (rows[40][0], None, *rows[40][2:])
    events = events_of(rows)
    found = asof_join(
        events.filter("message like 'Accepted%'"), events.filter("message like 'Failed%'"), ["user"], ["line_number"],
        order=["line_number"], direction=direction, tolerance=minutes and minutes * 60_000_000, settings=settings)
    assert found.columns == [*events.columns, "met_line_number"]
    want = nearest_of(parsed_rows(rows), direction, minutes and timedelta(minutes=minutes))
    assert {r.line_number: r.met_line_number for r in found.collect()} == want and found.count() == len(want)


def test_asof_carries_over_long_silence_and_takes_clashing_names(events_of):
    events = events_of([("2026-01-01T00:00:00", "a", None, "f"), ("2026-07-01T00:00:00", "a", None, "x")])
    one = events.filter("line_number = 2").withColumns({c: F.lit(1) for c in ("_at", "_row", "_rows", "_met", "_salt")})
    assert asof_join(one, events.filter("line_number = 1"), ["user"], ["message"]).first().met_message == "f"
    with pytest.raises(ValueError):
        asof_join(one.withColumn("met_message", F.lit(1)), events, ["user"], ["message"])
    empty = events.limit(0)
    assert asof_join(empty, events, ["user"], ["message"]).count() == 0
    assert asof_join(one, empty, ["user"], ["message"], direction="nearest").first().met_message is None


@BOTH
@pytest.mark.parametrize("by", [[], ["user"]])
def test_overlaps_match_all_pairs(spark, events_of, settings, by):
    rows = random_log(70, 3)
    events = events_of(rows)
    longs = F.when(F.col("line_number") % 9 == 0, 86_400 * 40).when(F.col("line_number") % 4 == 0, 1800).when(
        F.col("line_number") % 11 == 0, -5).otherwise(0)
    spans = events.withColumn("until", F.col("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), longs))
    pairs = overlap_join(spans, spans, ("timestamp", "until"), ("timestamp", "until"), by, settings=settings)
    got = sorted((r.left.line_number, r.right.line_number) for r in pairs.collect())
    data = [r for r in spans.collect() if r.timestamp and r.timestamp <= r.until]
    want = sorted((a.line_number, b.line_number) for a in data for b in data
                  if a.timestamp <= b.until and b.timestamp <= a.until and (not by or a.user == b.user))
    assert got == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_overlaps_of_nothing_and_of_repeats(spark):
    schema = "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ"
    at = datetime(2026, 1, 1)
    none, twice = spark.createDataFrame([], schema), spark.createDataFrame([(at, at)] * 2 + [(None, at), (at, None)], schema)
    assert overlap_join(none, twice, ("a", "b"), ("a", "b")).count() == 0
    assert overlap_join(twice, twice, ("a", "b"), ("a", "b"), settings=TINY).count() == 4


def sessions_of(rows, gap):
    out = []
    for user in {r[2] for r in rows} - {None}:
        end = None
        for at, until in sorted((r[1], r[1] + gap(r)) for r in rows if r[1] and r[2] == user):
            if end is None or at > end:
                out.append([user, at, until, 0])
                end = until
            end = max(end, until)
            out[-1][2:] = [end, out[-1][3] + 1]
    return sorted(map(tuple, out))


def gap():
    return F.when(F.col("message").startswith("Failed"), 100).otherwise(40)


def gap_of(row):
    return timedelta(seconds=100 if row[4].startswith("failed") else 40)


@BOTH
def test_sessions_match_their_definition(spark, events_of, settings):
    rows = random_log(200, 5)
    found = gap_sessions(events_of(rows), ["user"], gap(), settings=settings)
    assert sorted(map(tuple, found.collect())) == sessions_of(parsed_rows(rows), gap_of)


def test_sessions_without_a_gap(events_of):
    events = events_of([("2026-01-01T00:00:00", "a", None, "x"), (None, "a", None, "x")])
    assert gap_sessions(events, ["user"], F.lit(0)).count() == 0
    assert gap_sessions(events.limit(0), ["user"], F.lit(1)).count() == 0


def test_stream_gives_the_sessions_of_the_batch(spark, events_of, tmp_path):
    rows = sorted((r for r in random_log(120, 9) if r[0]), key=lambda r: r[0])
    rows.append(("2026-08-01T00:00:00", "z", None, "end"))  # moves the watermark beyond all others
    rows.append(("2026-08-02T00:00:00", "z", None, "end"))
    events = events_of(rows)
    for n, part in enumerate([(1, 50), (51, len(rows) - 2), (len(rows) - 1, len(rows) - 1), (len(rows), len(rows))]):
        events.filter(F.col("line_number").between(*part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_sessions(log, ["user"], gap(), "1 minute").writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").filter("user <> 'z'").collect()))
    want = gap_sessions(events, ["user"], gap()).filter("user <> 'z'")
    assert got == sorted(map(tuple, want.collect())) and got

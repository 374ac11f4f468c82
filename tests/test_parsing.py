from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logwarden.functions import text
from logwarden.functions.numbers import micros
from logwarden.sources.logs import format_line, parse_lines, read_lines, rejected_lines, write_lines

SAMPLE = """\
Mar 04 06:12:40 gate7 sshd[310]: Accepted password for nora from 172.20.3.9 port 40112 ssh2
Mar 04 06:30:01 gate7 sshd[311]: Accepted publickey for piet from 172.20.3.44 port 40240 ssh2
Mar 04 07:02:15 gate7 sshd[402]: Failed password for opsroot from 198.51.100.77 port 33001 ssh2
Mar 04 07:02:16 gate7 sshd[403]: Failed password for opsroot from 198.51.100.77 port 33002 ssh2
Mar 04 07:02:19 gate7 sshd[404]: Failed password for opsroot from 198.51.100.77 port 33003 ssh2
Mar 04 07:02:20 gate7 sshd[405]: Failed password for opsroot from 198.51.100.77 port 33004 ssh2
Mar 04 07:02:33 gate7 sshd[406]: Accepted password for opsroot from 198.51.100.77 port 33009 ssh2
Mar 04 07:03:10 gate7 sudo[421]: opsroot : COMMAND=/usr/bin/su root
Mar 04 07:04:58 gate7 usermod[425]: new user 'helper9' added to group wheel
Mar 04 08:20:00 gate7 sshd[466]: Accepted password for nora from 172.20.3.9 port 41877 ssh2
Mar 04 08:59:59 gate7 CRON[470]: (root) CMD (/usr/local/bin/rotate)
"""


def parse(spark, *values, year=2026):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], "line_number BIGINT, value STRING")
    return {r["line_number"]: r for r in parse_lines(rows, year).collect()}


def test_sample_log(spark, tmp_path):
    (tmp_path / "sample.log").write_text(SAMPLE)
    lines = read_lines(spark, str(tmp_path / "sample.log"))
    events = {r["line_number"]: r for r in parse_lines(lines, 2026).collect()}
    assert sorted(events) == list(range(1, 12))
    assert [events[i]["pid"] for i in (1, 2, 3, 7, 8, 9, 10, 11)] == ["310", "311", "402", "406", "421", "425", "466", "470"]
    assert [events[i]["user"] for i in range(1, 12)] == [
        "nora", "piet", *["opsroot"] * 5, "unknown", "unknown", "nora", "unknown"]
    assert events[1]["template"] == "Accepted password for nora from <IP> port <PORT> ssh2"
    assert events[3]["source_ip"] == "198.51.100.77"
    assert events[8]["template"] == "opsroot : COMMAND=/usr/bin/su root" and events[8]["source_ip"] is None
    assert events[9]["template"] == "new user 'helper9' added to group wheel"
    assert events[11]["timestamp"] == datetime(2026, 3, 4, 8, 59, 59)


@pytest.mark.parametrize("line, stamp", [
    ("Jul  8 01:02:03 h p[1]: m", datetime(2026, 7, 8, 1, 2, 3)),
    ("jul 08 01:02:03 h p: m", datetime(2026, 7, 8, 1, 2, 3)),
    ("Feb 29 01:02:03 h p: m", None),
    ("Jul 18 24:00:00 h p: m", None),
    ("Jul 18 23:00:60 h p: m", None),
    ("Foo 18 23:00:00 h p: m", None),
    ("Jul 00 23:00:00 h p: m", None),
])
def test_dates(spark, line, stamp):
    assert parse(spark, line)[1]["timestamp"] == stamp


def test_leap_year_is_the_given_year(spark):
    assert parse(spark, "Feb 29 01:02:03 h p: m", year=2024)[1]["timestamp"] == datetime(2024, 2, 29, 1, 2, 3)


def test_lines_of_another_format_are_dropped(spark):
    values = ["", "free text", "Jul 18 10:00:00 host proc no colon", "Jul 18 10:00:00 host proc: kept"]
    assert list(parse(spark, *values)) == [4]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line_number BIGINT, value STRING")
    assert rejected_lines(rows).count() == 3


def test_whitespace_of_every_kind(spark):
    line = "　\tJul 18  10:00:00 host\tproc[7]:  two words  \x1f"
    row = parse(spark, line)[1]
    assert (row["host"], row["process"], row["pid"], row["message"]) == ("host", "proc", "7", "two words")


@pytest.mark.parametrize("message, user", [
    ("session opened for USER alice", "alice"),
    ("Failed password for invalid user admin from 1.2.3.4", "admin"),
    ("Failed password for john.doe from 1.2.3.4", "unknown"),
    ("Failed password for Jürgen from 1.2.3.4", "Jürgen"),
    ("new user 'backdoor01' added", "unknown"),
    ("user=abc- x", "abc"),
    ("superuser root", "unknown"),
    ("USER=x for y from z", "x"),
    ("accepted For x from z", "unknown"),
])
def test_users(spark, message, user):
    assert parse(spark, f"Jul 18 10:00:00 h p: {message}")[1]["user"] == user


@pytest.mark.parametrize("message, ip, template", [
    ("from 999.1.1.1 x", "999.1.1.1", "from <IP> x"),
    ("1.2.3.4.5", "1.2.3.4", "<IP>.<NUM>"),
    ("v1.2.3.4", None, "v1.<NUM>.<NUM>.<NUM>"),
    ("1.2.3.4a", None, "<NUM>.<NUM>.<NUM>.4a"),
    ("sshd[22]: uid=0 ssh2 backdoor01", None, "sshd[<PID>]: uid=<NUM> ssh2 backdoor01"),
    ("port 22 port 22x report 5", None, "port <PORT> port 22x report <NUM>"),
    ("no variables", None, "no variables"),
    ("é5 5é 5", None, "é5 5é <NUM>"),
])
def test_masks(spark, message, ip, template):
    row = parse(spark, f"Jul 18 10:00:00 h p: {message}")[1]
    assert (row["source_ip"], row["template"]) == (ip, template)


def test_identity_and_field(spark):
    values = ["alice", " Bob ", "Unknown", "N/A", "-", "?", "none", "nan", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v STRING").select(
        text.identity_of(F.col("v")).alias("i"), text.field_of(F.col("v")).alias("f")).collect()
    assert [r["i"] for r in rows] == ["alice", "Bob", None, None, None, None, None, "nan", None, None]
    assert [r["f"] for r in rows] == ["alice", "Bob", None, "N/A", "-", "?", None, None, None, None]


def test_format_leaves_out_an_absent_pid(spark):
    rows = spark.sql("select timestamp_ntz'2026-07-08 01:02:03' ts, 'p' process, pid, 'm' message "
                     "from values (7), (cast(null as int)), (0) t(pid)")
    assert [r[0] for r in rows.select(format_line()).collect()] == [
        "Jul 08 01:02:03 server1 p[7]: m", "Jul 08 01:02:03 server1 p: m", "Jul 08 01:02:03 server1 p: m"]


def test_line_numbers_over_many_files_and_splits(spark, tmp_path):
    lines = spark.range(1, 5001).select(
        F.col("id").alias("line_number"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    path = str(tmp_path / "log")
    write_lines(lines, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8KB")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        back = read_lines(spark, path, across_files=True)
        assert back.filter(F.col("value") != F.concat(F.lit("line "), F.col("line_number").cast("string"))).count() == 0
        assert back.count() == 5000
        per_file = read_lines(spark, path).groupBy("path").agg(
            F.min("line_number").alias("lo"), F.max("line_number").alias("hi"), F.count("*").alias("n")).collect()
        assert all(r["lo"] == 1 and r["hi"] == r["n"] for r in per_file)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "bad.log").write_bytes(b"Jul 18 10:00:00 h p: a\xffb\n")
    row = parse_lines(read_lines(spark, str(tmp_path / "bad.log")), 2026).first()
    assert row["message"] == "ab"


def test_wall_clock_in_any_time_zone(spark):
    """02:30 does not exist in New York on this day, and must survive all the same."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = parse(spark, "Mar  8 02:30:00 h p: m")[1]
        assert row["timestamp"] == datetime(2026, 3, 8, 2, 30)
        events = spark.sql("select timestamp_ntz'2026-03-08 02:30:00' ts, 'p' process, 1 pid, 'm' message")
        assert events.select(format_line()).first()[0] == "Mar 08 02:30:00 server1 p[1]: m"
        assert events.select(micros(F.col("ts"))).first()[0] == 1772937000000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_line_is_searched_for_its_head_once(spark, tmp_path):
    spark.createDataFrame([(1, "Jul 14 10:00:00 h sshd[1]: Accepted password for u01 from 10.0.0.1 port 1 ssh2"), (2, "x"), (3, None)],
                          "line_number BIGINT, value STRING").write.parquet(str(tmp_path / "lines"))
    parsed = parse_lines(spark.read.parquet(str(tmp_path / "lines")), 2026)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("{3}[") == 1  # the start of the pattern stands in one operator, not in a filter and a projection
    assert [(r["line_number"], r["user"], r["source_ip"]) for r in parsed.collect()] == [(1, "u01", "10.0.0.1")]

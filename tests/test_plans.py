"""The plans that matter at scale: pruning, limits before shuffles, no cross joins."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import tables as t
from catalog.spark_queries import QUERIES
from logwarden.operators import assembly, prompts, rules, triage
from logwarden.config import Settings
from logwarden.operators.joins import attach
from logwarden.operators.travel import travel_lines
from logwarden.sources.logs import read_lines
from logwarden.sources.tables import read_parsed, write_parsed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "parsed")
    write_parsed(t.parsed(spark, SF), path)
    return read_parsed(spark, path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan):
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan))))


def test_travel_reads_only_what_it_needs(parsed):
    plan = plan_of(travel_lines(parsed))
    assert read_columns(plan) == {"line_number", "timestamp", "message", "user", "source_ip"}
    assert "IsNotNull(source_ip)" in plan and "PushedFilters" in plan


def test_line_numbers_do_not_move_the_log(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    plan = plan_of(read_lines(spark, str(tmp_path)))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_wide_tables_are_not_broadcast(spark):
    left = spark.range(50).withColumn("k", F.col("id") % 5)
    right = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert "BroadcastHashJoin" in plan_of(attach(left, right, ["k"]))
    small = Settings(broadcast_bytes=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(attach(left, right, ["k"], settings=small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keyword_rule_is_one_narrow_scan(parsed):
    plan = plan_of(rules.privileged_command_lines(parsed))
    assert read_columns(plan) == {"line_number", "message"} and "Exchange" not in plan


def test_first_events_are_cut_before_the_shuffle(spark):
    tagged, table = t.tagged(spark, SF), t.incidents(spark, SF)
    assert plan_of(prompts.events_block(["incident_id"], tagged, table)).count("WindowGroupLimit") == 2
    scenarios = table.selectExpr("incident_id", "if(incident_id % 2 = 0, 'A', 'B') as scenario")
    assert plan_of(triage.pick_samples(table, scenarios)).count("WindowGroupLimit") == 2


def test_top_of_the_board_is_a_distributed_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(triage.triage_order(t.incidents(spark, SF), 20))


def test_incident_aggregates_start_on_the_map_side(spark):
    plan = plan_of(assembly.incident_table(t.tagged(spark, SF)))
    assert "partial_max_by" in plan and "partial_count" in plan


@pytest.mark.parametrize("name", ["flagship", "impossible_travel", "rules_fired", "incidents", "incident_prompts",
                                  "run_counters", "forest_scores", "triage_board"])
def test_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

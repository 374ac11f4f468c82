"""Global ranks and mergeable sketches against exact figures."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import TINY
from logwarden.config import DEFAULTS
from logwarden.operators.ranking import rank_rows, tile_rows
from logwarden.operators.sketches import daily_sketches, estimates, merge_sketches


@pytest.mark.parametrize("settings", [DEFAULTS, TINY])
def test_ranks_with_heavy_ties(spark, settings):
    rng = random.Random(4)
    rows = [(i, rng.choice([1.0, 1.0, 1.0, None, float("nan"), -0.0, 0.0, rng.random()])) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(6)
    got = rank_rows(df, ["v"], "id", settings)
    w = Window.orderBy("v")
    want = df.select("id", F.rank().over(w), F.dense_rank().over(w), F.percent_rank().over(w), F.cume_dist().over(w))
    found = got.select("id", "rank", "dense_rank", "percent_rank", "cume_dist")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    tiled = tile_rows(got, ["v", "id"], 7)
    assert {r.id: r.ntile for r in tiled.collect()} == {
        r.id: r.n for r in df.select("id", F.ntile(7).over(Window.orderBy("v", "id")).alias("n")).collect()}


def test_ranks_of_few_rows(spark):
    one = spark.createDataFrame([(1, None)], "id bigint, v int")
    assert tuple(rank_rows(one, ["v"], "id").first())[2:] == (1, 1, 0.0, 1.0)
    assert rank_rows(one.limit(0), ["v"], "id").count() == 0
    assert [r.ntile for r in tile_rows(one, ["id"], 3).collect()] == [1]
    with pytest.raises(ValueError):
        rank_rows(one.withColumn("rank", F.lit(1)), ["v"], "id")


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("k"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("d"),
        (F.col("id") * 7919 % 30_011).alias("v"))
    daily = daily_sketches(rows, ["k"], F.col("d"), "v", "v")
    assert daily.count() == 60
    months = merge_sketches(daily, ["k"])
    weeks = merge_sketches(daily.groupBy("k", (F.dayofmonth("day") % 4).alias("w")).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_bigint("measure_sketch").alias("measure_sketch")), ["k"])
    exact = {r.k: (r.n, r.u) for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("v").alias("u")).collect()}
    for merged in (months, weeks):
        found = estimates(merged, {"low": 0.1, "median": 0.5, "high": 0.9})
        for r in found.collect():
            n, u = exact[r.k]
            assert r.rows == n and abs(r.distinct_estimate - u) <= 0.08 * u
            for q, v in ((0.1, r.low), (0.5, r.median), (0.9, r.high)):
                assert abs(rows.filter((F.col("k") == r.k) & (F.col("v") <= v)).count() / n - q) <= 0.03


def test_sketches_of_missing_values(spark):
    rows = spark.createDataFrame([("a", "2026-01-01", None, None), (None, "2026-01-01", "x", 1), ("a", None, "x", 1)], "k string, d string, v string, m int")
    found = estimates(daily_sketches(rows, ["k"], F.col("d").cast("date"), "v", "m"), {"median": 0.5}).collect()
    assert [(r.k, r.rows, r.distinct_estimate, r.median) for r in found] == [("a", 1, 0, None)]

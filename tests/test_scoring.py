import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import TINY
from logwarden.config import DEFAULTS, Settings
from logwarden.operators import forest
from logwarden.operators.embed import attach_embeddings, embed_templates
from logwarden.operators.joins import attach
from logwarden.operators.ordering import number_rows
from logwarden.operators.quantiles import weighted_quantiles

SMALL = Settings(trees=20)


@pytest.fixture(scope="module")
def blobs(spark):
    """Two users with a tight cloud and two far points each; one user with three rows."""
    rng = np.random.default_rng(0)
    rows = []
    for user, centre, n in (("a", 0.0, 60), ("b", 5.0, 40), ("rare", 2.0, 3)):
        for i in range(n):
            far = 30.0 if user != "rare" and i < 2 else 0.0
            rows.append((user, f"{user}{i}", 1 if far or user == "rare" else int(rng.integers(1, 4)),
                         [float(x) for x in rng.normal(centre + far, 0.1, 8)]))
    return spark.createDataFrame(rows, "user STRING, template STRING, n BIGINT, embedding ARRAY<FLOAT>")


def run_forest(blobs, settings):
    pairs, vectors = blobs.select("user", "template", "n"), blobs.select("template", "embedding")
    population = forest.population(pairs, settings)
    grown = forest.fit_forests(population, vectors, settings)
    scored = forest.score_population(population, vectors, grown, settings)
    limits = forest.offsets(scored, [settings.contamination])
    return scored.toPandas(), forest.decide(pairs, scored, limits).toPandas()


def test_forest_properties(blobs):
    scored, verdicts = run_forest(blobs, SMALL)
    assert scored["score"].between(-1, 0, inclusive="neither").all()
    assert set(scored["model"]) == {"user:a", "user:b", "global"}
    assert len(verdicts) == blobs.count()
    for user in ("a", "b"):
        mine = scored[scored["model"] == f"user:{user}"].sort_values("score")
        assert set(mine["template"].head(2)) == {f"{user}0", f"{user}1"}
        v = verdicts[verdicts["user"] == user]
        n, flagged = v["n"].sum(), v.loc[v["ml_anomaly"], "n"].sum()
        assert 0 < flagged <= np.ceil(0.2 * (n - 1))


def test_few_rows_use_the_global_model(blobs):
    rows = blobs.withColumn("n", F.lit(1).cast("bigint"))
    scored, verdicts = run_forest(rows, SMALL)
    common = scored[scored["model"] == "global"].set_index("template")["score"]
    cut = np.quantile(common.repeat(scored[scored["model"] == "global"].set_index("template")["n"]), 0.2)
    for _, row in verdicts[verdicts["user"] == "rare"].iterrows():
        assert row["anomaly_score"] == pytest.approx(common[row["template"]] - cut)


def test_partitions_and_limits_change_nothing(spark, blobs):
    first = run_forest(blobs, SMALL)[1]
    split = Settings(trees=20, models_rows_per_task=7, broadcast_rows=0, heavy_key_rows=5)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        second = run_forest(blobs.repartition(5), split)[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = ["user", "template"]
    pd.testing.assert_frame_equal(first.sort_values(key).reset_index(drop=True),
                                  second.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize(("copies", "slice_of"), [(1, 20_000), (40, 20_000), (40, 7)])
def test_every_line_has_the_same_chance_at_any_size(spark, monkeypatch, copies, slice_of):
    monkeypatch.setattr(forest, "DRAW_SLICE", slice_of)
    settings = Settings(trees=200, subsample=16)
    rows = spark.range(30).select(
        F.lit("m").alias("model"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("template"),
        ((1 + F.col("id") % 3) * copies).alias("n"), F.lit(60 * copies).cast("bigint").alias("total"),
        F.lit(30).cast("bigint").alias("templates"))
    drawn = {r["template"]: r["drawn"] for r in forest.draw_lines(rows, settings).collect()}
    per_tree = np.zeros(200, int)
    for entries in drawn.values():
        for e in entries:
            per_tree[e["tree"]] += e["m"]
    assert (per_tree == 16).all()  # each tree draws for itself, the same number from any model
    for r in rows.collect():
        taken = [e["m"] for e in drawn[r["template"]]]
        assert max(taken) <= r["n"]
        expected = 200 * 16 * r["n"] / r["total"]
        assert abs(sum(taken) - expected) < 5 * expected**0.5
    # the whole model where it has no more lines than a tree may draw
    small = rows.filter("template in ('t0', 't1')").withColumn("n", F.lit(3).cast("bigint")).withColumn("total", F.lit(6).cast("bigint"))
    whole = {r["template"]: [e["m"] for e in r["drawn"]] for r in forest.draw_lines(small, settings).collect()}
    assert whole == {"t0": [3] * 200, "t1": [3] * 200}


def test_large_models_score_alike_again(spark):
    settings = Settings(trees=4, subsample=16)
    rows = spark.range(3000).select(
        F.lit("u").alias("user"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("template"),
        (F.lit(1) + F.col("id") % 3).cast("bigint").alias("n"),
        F.array((F.col("id") % 50).cast("float"), F.when(F.col("id") == 7, 900.0).otherwise(1.0).cast("float")).alias("embedding"))
    scored, verdicts = run_forest(rows, settings)
    assert len(verdicts) == 3000 and scored["score"].between(-1, 0).all()
    again, _ = run_forest(rows, settings)
    assert again.set_index(["model", "template"])["score"].sort_index().equals(
        scored.set_index(["model", "template"])["score"].sort_index())


def test_identical_rows_are_all_inliers(spark):
    rows = spark.createDataFrame([("u", "t", 50, [1.0, 2.0])], "user STRING, template STRING, n BIGINT, embedding ARRAY<FLOAT>")
    verdicts = run_forest(rows, SMALL)[1]
    assert verdicts["anomaly_score"].tolist() == [0.0] and not verdicts["ml_anomaly"].any()


def test_equal_templates_equal_verdicts_and_embeddings(spark, events_of):
    events = events_of([("2026-07-14 10:00:00", "a", None, "m")] * 30).withColumn(
        "template", F.concat(F.lit("word"), (F.col("line_number") % 4).cast("string"), F.lit(" same <IP>")))
    scored = forest.score_events(events, SMALL)
    assert scored.count() == 30
    assert scored.groupBy("template").agg(F.countDistinct("anomaly_score").alias("k")).filter("k > 1").count() == 0
    vectors = embed_templates(events)
    assert vectors.count() == 4 and vectors.filter(F.size("embedding") != 384).count() == 0
    with_vectors = attach_embeddings(events, TINY)
    assert with_vectors.count() == 30 and with_vectors.filter("embedding is null").count() == 0


def test_own_encoder(events_of):
    def lengths(batches):
        for texts in batches:
            yield texts.map(lambda t: [float(len(t)), 1.0])

    events = events_of([("2026-07-14 10:00:00", "a", None, "m")] * 3).withColumn("template", F.lit("abc"))
    assert embed_templates(events, encode=lengths).first()["embedding"] == [3.0, 1.0]


@pytest.mark.parametrize("bins", ["floor(v * 4)", "0", "floor(v * 1000)"])
def test_quantiles_match_numpy(spark, bins):
    rng = np.random.default_rng(3)
    data = [(g, float(np.round(rng.normal(), 2)), int(rng.integers(1, 5))) for g in "xyz" for _ in range(40)]
    data.append(("one", 0.5, 1))
    shares = [0.0, 0.05, 0.2, 0.5, 1.0]
    found = weighted_quantiles(spark.createDataFrame(data, "g STRING, v DOUBLE, w BIGINT"), ["g"], "v", F.col("w"), shares, F.expr(bins))
    rows = {(r["g"], r["share"]): r["quantile"] for r in found.collect()}
    assert len(rows) == 4 * len(shares)
    for (g, share), value in rows.items():
        sample = np.repeat([v for k, v, _ in data if k == g], [w for k, _, w in data if k == g])
        assert value == pytest.approx(np.quantile(sample, share))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("settings", [DEFAULTS, TINY, Settings(broadcast_rows=0)], ids=["broadcast", "split keys", "plain"])
def test_attach_is_a_join(spark, how, settings):
    left = spark.range(200).select(F.col("id").alias("line_number"), F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 7).alias("k"))
    right = left.filter("k != 3").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 10)
    found = attach(left, right, ["k"], how=how, rows="n", settings=settings)
    expected = left.join(right.drop("n"), ["k"], how)
    assert sorted(map(tuple, found.select("line_number", "k", "x").collect()), key=str) == sorted(
        map(tuple, expected.select("line_number", "k", "x").collect()), key=str)


def test_numbering(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(6)
    assert [r["n"] for r in number_rows(rows, ["v"], "n").orderBy("v").collect()] == list(range(1, 1001))
    grouped = number_rows(rows, [F.desc("v")], "n", start=0, within=["g"]).toPandas()
    for _, part in grouped.groupby("g"):
        assert part.sort_values("v", ascending=False)["n"].tolist() == list(range(len(part)))

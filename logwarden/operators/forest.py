"""Isolation forests per user with a global fallback (Liu, Ting, Zhou, ICDM 2008).

Lines with equal templates have equal vectors, so everything works on one row per
(user, template) with a count. A model belongs to a user or is the global one,
which is trained on all lines and scores users with too few lines of their own.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.operators.embed import Encoder, settled_embeddings
from logwarden.operators.joins import attach, join_totals
from logwarden.operators.quantiles import weighted_quantiles
from logwarden.session import settle, spread

# the group functions travel to the executors themselves; no package is needed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GLOBAL = "global"
DRAW_SLICE = 20_000  # templates of a model drawn together; fixed, because the random streams depend on it
TREE_COLUMNS = ["tree", "size", "feature", "threshold", "left", "right", "path"]
TREE_SCHEMA = (
    "tree INT, size INT, feature ARRAY<INT>, threshold ARRAY<DOUBLE>, "
    "left ARRAY<INT>, right ARRAY<INT>, path ARRAY<DOUBLE>"
)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree over ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    long = 2.0 * harmonic - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


_depths: dict[int, float] = {}  # an entry for each size of a node, up to the subsample


def _mean_depth(n: int) -> float:
    if n not in _depths:
        _depths[n] = float(average_path(n))
    return _depths[n]


def grow_tree(x: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[list, list, list, list, list]:
    """One random tree over distinct vectors ``x`` that occur ``weight`` times."""
    depth_limit = int(np.ceil(np.log2(max(weight.sum(), 2))))
    feature, threshold, left, right, path = [], [], [], [], []
    # a feature that is equal in all vectors is never cut
    named = np.flatnonzero(np.maximum.reduce(x, axis=0) > np.minimum.reduce(x, axis=0)) if len(x) else np.empty(0, int)
    x = x[:, named]
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        size = int(weight[rows].sum())
        path.append(depth + _mean_depth(size))
        if size <= 1 or depth >= depth_limit or len(rows) < 2:
            continue
        held = x.take(rows, axis=0)
        low, high = np.minimum.reduce(held, axis=0), np.maximum.reduce(held, axis=0)
        varying = (high > low).nonzero()[0]
        if not len(varying):
            continue
        chosen = int(varying[rng.integers(len(varying))])
        cut = float(rng.uniform(low[chosen], high[chosen]))
        values = held[:, chosen]
        goes_right = values > cut
        above = rows[goes_right]
        if not len(above):  # rounding can push the cut onto the largest value
            cut = float(low[chosen])
            goes_right = values > cut
            above = rows[goes_right]
        feature[node], threshold[node] = int(named[chosen]), cut
        todo.append((above, depth + 1, node, True))
        todo.append((rows[~goes_right], depth + 1, node, False))
    return feature, threshold, left, right, path


def path_lengths(x: np.ndarray, trees: Sequence[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Depth of every vector in every tree, a row per tree; all trees are walked at once."""
    ends = np.cumsum([len(t[0]) for t in trees])
    starts = ends - [len(t[0]) for t in trees]
    feature, threshold, left, right, path = (np.concatenate([np.asarray(t[k]) for t in trees]) for k in range(5))
    at = np.repeat(starts, len(x))  # children are counted inside their tree
    base, row = at.copy(), np.tile(np.arange(len(x)), len(trees))
    inner = np.flatnonzero(feature[at] >= 0)
    while len(inner):
        here = at[inner]
        goes_left = x[row[inner], feature[here]] <= threshold[here]
        at[inner] = base[inner] + np.where(goes_left, left[here], right[here])
        inner = inner[feature[at[inner]] >= 0]
    return path[at].reshape(len(trees), len(x))


def _seeded(*parts: object) -> np.random.Generator:
    digest = hashlib.md5("|".join(map(str, parts)).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest, "little"))


def model_of(user: Column) -> Column:
    return F.concat(F.lit("user:"), user)


def population(pairs: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """Rows each model is fitted on: ``(run..., model, template, n, total, templates)``.

    ``pairs`` holds ``(run..., user, template, n)``.
    """
    run = list(run)
    sums = pairs.groupBy(*run, "user").agg(F.sum("n").alias("total"), F.count("*").alias("templates"))
    fitted = sums.filter(F.col("total") >= settings.min_rows_per_user).withColumn("_rows", F.col("templates"))
    own = attach(pairs, fitted, [*run, "user"], how="inner", rows="_rows", salt_on="template", settings=settings)
    every = pairs.groupBy(*run, "template").agg(F.sum("n").alias("n"))
    whole = every.groupBy(*run).agg(F.sum("n").alias("total"), F.count("*").alias("templates"))
    everyone = join_totals(every, whole, run)
    columns = ["model", "template", "n", "total", "templates"]
    return own.withColumn("model", model_of(F.col("user"))).select(*run, *columns).unionByName(
        everyone.withColumn("model", F.lit(GLOBAL)).select(*run, *columns)
    )


def _picked(ends: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``size`` different lines fall to each of the groups that end at ``ends``."""
    lines = rng.choice(int(ends[-1]), size, replace=False, shuffle=False)
    return np.bincount(np.searchsorted(ends, lines, side="right"), minlength=len(ends))


def draw_lines(rows: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()) -> DataFrame:
    """Every tree's own lines as ``(run..., model, template, drawn ARRAY<(tree, m)>)``.

    Each tree draws min(subsample, n) different ones of all n lines of its model, whatever
    n is. Only the counts per template are drawn (a multivariate hypergeometric law): first
    those of the slices of a model, then, inside each slice, those of its templates. So no
    task holds all templates of a model, and rows number templates, not lines.
    """
    keys = [*run, "model"]
    trees, subsample, seed = settings.trees, settings.subsample, settings.seed
    types = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    slices = F.greatest(F.ceil(F.col("templates") / DRAW_SLICE).cast("bigint"), F.lit(1))
    sliced = rows.select(*keys, "template", "n", F.pmod(F.xxhash64("template"), slices).alias("_slice"))
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_sum"))
    # one entry for each DRAW_SLICE templates
    models = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slice", "_sum"))).alias("_sums")).select(
        *keys, F.col("_sums._slice").alias("_slices"), F.col("_sums._sum").alias("_sizes"))

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key, ends = row[:-2], np.cumsum(row[-1])
                size = min(subsample, int(ends[-1]))
                if len(ends) == 1:
                    taken = np.full((trees, 1), size)
                else:
                    taken = np.array([_picked(ends, size, _seeded(seed, *key, t, "slices")) for t in range(trees)])
                for at in np.flatnonzero(taken.any(axis=0)):
                    out.append((*key, int(row[-2][at]), taken[:, at].astype(np.int32)))
            yield pd.DataFrame(out, columns=[*keys, "_slice", "_taken"])

    taken = spread(models, *keys).mapInPandas(share, f"{named}, _slice BIGINT, _taken ARRAY<INT>")

    def draw(key: tuple, group: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "template", "tree", "m"]
        if not len(group) or not len(taken):
            return pd.DataFrame({c: [] for c in columns})
        group = group.sort_values("template")
        ends, counts = np.cumsum(group["n"].to_numpy()), np.zeros((trees, len(group)), np.int32)
        for tree, size in enumerate(taken["_taken"].iloc[0]):
            if size:
                counts[tree] = _picked(ends, int(size), _seeded(seed, *key, tree, "lines"))
        used = np.flatnonzero(counts.any(axis=0))
        held = [np.flatnonzero(counts[:, at]) for at in used]
        found = group[[*keys, "template"]].iloc[used]
        return found.assign(tree=[t.astype(np.int32) for t in held], m=[counts[t, at] for t, at in zip(held, used)])

    by = [*keys, "_slice"]
    left, right = spread(sliced, *by).groupBy(*by), spread(taken, *by).groupBy(*by)
    found = left.cogroup(right).applyInPandas(draw, f"{named}, template STRING, tree ARRAY<INT>, m ARRAY<INT>")
    return found.select(*keys, "template", F.arrays_zip("tree", "m").alias("drawn"))


def fit_forests(
    rows: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = ()
) -> DataFrame:
    """One row per tree. Only drawn lines meet their vectors: trees * subsample of them per model at most."""
    keys = [*run, "model"]
    drawn = draw_lines(rows, settings, run).withColumns({"_trees": F.col("drawn.tree"), "_counts": F.col("drawn.m")})
    training = drawn.drop("drawn").join(vectors, "template")
    trees, seed = settings.trees, settings.seed

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("template")
        x = np.array(group["embedding"].tolist(), dtype=np.float64)
        counts = np.zeros((trees, len(group)), dtype=np.int64)
        for at, (held, taken) in enumerate(zip(group["_trees"], group["_counts"])):
            counts[held, at] = taken
        out = []
        for tree in range(trees):
            used = np.flatnonzero(counts[tree])
            rng = _seeded(seed, *key, tree)
            out.append((*key, tree, int(counts[tree].sum()), *grow_tree(x[used], counts[tree, used], rng)))
        return pd.DataFrame(out, columns=[*keys, *TREE_COLUMNS])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), TREE_SCHEMA])
    return spread(training, *keys).groupBy(*keys).applyInPandas(build, schema)


def score_population(
    rows: DataFrame,
    vectors: DataFrame,
    forests: DataFrame,
    settings: Settings = DEFAULTS,
    run: Sequence[str] = (),
) -> DataFrame:
    """``(run..., model, template, n, score)``; scores lie in (-1, 0), lower is stranger.

    A model with many templates is scored in several slices, each with its own
    copy of the forest, so that no task holds all templates of one model.
    """
    run = list(run)
    keys = [*run, "model"]
    slices = F.ceil(F.col("templates") / settings.models_rows_per_task).cast("bigint")
    sliced = (
        rows.select(*keys, "template", "n", F.pmod(F.xxhash64("template"), slices).alias("_slice"))
        .join(vectors, "template")
    )
    counts = rows.groupBy(*keys).agg(F.max(slices).alias("_slices"))
    copies = forests.join(counts, keys).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1))
    ).drop("_slices")

    def score(key: tuple, group: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({c: [] for c in [*keys, "template", "n", "score"]})
        x = np.array(group["embedding"].tolist(), dtype=np.float64)
        depth = np.zeros(len(x))
        trees = list(forest.sort_values("tree")[TREE_COLUMNS[2:]].itertuples(index=False, name=None))
        for paths in path_lengths(x, trees):
            depth += paths
        typical = float(average_path(forest["size"].iloc[0])) * len(forest)
        strangeness = np.ones(len(x)) if typical == 0 else 2.0 ** (-depth / typical)
        return group[[*keys, "template", "n"]].assign(score=-strangeness)

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "template STRING, n BIGINT, score DOUBLE"])
    by = [*keys, "_slice"]
    left, right = spread(sliced, *by).groupBy(*by), spread(copies, *by).groupBy(*by)
    return left.cogroup(right).applyInPandas(score, schema)


def offsets(
    scored: DataFrame, shares: Sequence[float], run: Sequence[str] = ()
) -> DataFrame:
    """``(run..., model, share, quantile)``: the score below which a line is an outlier."""
    bins = F.floor(F.col("score") * 65536)
    return weighted_quantiles(scored, [*run, "model"], "score", F.col("n"), shares, bins)


def score_templates(
    events: DataFrame,
    settings: Settings = DEFAULTS,
    run: Sequence[str] = (),
    shares: Sequence[float] | None = None,
    encode: Encoder | None = None,
) -> DataFrame:
    """``(run..., user, template, n, share, anomaly_score, ml_anomaly)``.

    One row per (user, template) and contamination share. The forests do not
    depend on the share, so a sweep costs one fit and one more quantile each.
    """
    return score_counts(events.groupBy(*run, "user", "template").agg(F.count("*").alias("n")), settings, run, shares, encode)


def score_counts(
    counts: DataFrame,
    settings: Settings = DEFAULTS,
    run: Sequence[str] = (),
    shares: Sequence[float] | None = None,
    encode: Encoder | None = None,
) -> DataFrame:
    """As ``score_templates``, of events that are counted already: ``(run..., user, template, n)``, in any number of rows."""
    run = list(run)
    shares = [settings.contamination] if shares is None else list(shares)
    filled = counts.withColumn("template", F.coalesce("template", F.lit("")))
    pairs = settle(filled.groupBy(*run, "user", "template").agg(F.sum("n").alias("n")))
    vectors = settled_embeddings(pairs.select("template"), settings, encode)
    rows = settle(population(pairs, settings, run))
    forests = settle(fit_forests(rows, vectors, settings, run))
    scored = settle(score_population(rows, vectors, forests, settings, run))
    limits = settle(offsets(scored, shares, run))
    return decide(pairs, scored, limits, run)


def decide(pairs: DataFrame, scored: DataFrame, limits: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Score minus offset by the user's own model, or by the global one if there is none."""
    run = list(run)
    fallback = limits.filter(F.col("model") == GLOBAL).select(*run, "share", F.col("quantile").alias("_global"))
    own = scored.select(*run, "model", "template", F.col("score").alias("_own"))
    common = scored.filter(F.col("model") == GLOBAL).select(*run, "template", F.col("score").alias("_common"))
    own_limit = limits.filter(F.col("model") != GLOBAL).select(
        *run, "model", "share", F.col("quantile").alias("_limit")
    )
    named = pairs.withColumn("model", model_of(F.col("user"))).join(own, [*run, "model", "template"], "left")
    mine = named.filter(F.col("_own").isNotNull()).join(own_limit, [*run, "model"]).select(
        *run, "user", "template", "n", "share", (F.col("_own") - F.col("_limit")).alias("anomaly_score")
    )
    unfitted = named.filter(F.col("_own").isNull()).drop("_own").join(common, [*run, "template"])
    others = join_totals(unfitted, fallback, run).select(
        *run, "user", "template", "n", "share", (F.col("_common") - F.col("_global")).alias("anomaly_score")
    )
    return mine.unionByName(others).withColumn("ml_anomaly", F.col("anomaly_score") < 0)


def score_events(
    events: DataFrame, settings: Settings = DEFAULTS, run: Sequence[str] = (), encode: Encoder | None = None
) -> DataFrame:
    """Add ``anomaly_score`` (below zero is an outlier) and ``ml_anomaly`` to every event."""
    verdicts = score_templates(events, settings, run, encode=encode).drop("share")
    filled = events.withColumn("template", F.coalesce("template", F.lit("")))
    return attach(filled, verdicts, [*run, "user", "template"], how="inner", rows="n", settings=settings)

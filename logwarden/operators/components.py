"""Connected components of a large sparse graph by alternating star steps.

Each round rewires edges towards the smallest neighbour: first for neighbours
above a node, then for those below it (Kiveris et al., SoCC 2014). The number of
rounds grows with the logarithm of the diameter, and no neighbourhood is ever
gathered: a step is one aggregation and one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.config import DEFAULTS, Settings
from logwarden.operators.joins import attach
from logwarden.session import settle


def _rewire(links: DataFrame, by: list[str], size: int, settings: Settings) -> DataFrame:
    """For links (node, near): the smallest of each neighbourhood, node included.

    ``size`` bounds the number of nodes; a graph known to be small needs no
    further look at the sizes of its tables.
    """
    lowest = links.groupBy(*by, "node").agg(
        F.least(F.min("near"), F.first("node")).alias("least"), F.count("*").alias("_degree")
    )
    if size <= settings.broadcast_rows:
        return links.join(F.broadcast(lowest.drop("_degree")), [*by, "node"])
    return attach(links, lowest, [*by, "node"], how="inner", rows="_degree", salt_on="near", settings=settings)


def _large_star(stars: DataFrame, by: list[str], size: int, settings: Settings) -> DataFrame:
    up = stars.select(*by, F.col("low").alias("node"), F.col("high").alias("near"))
    down = stars.select(*by, F.col("high").alias("node"), F.col("low").alias("near"))
    linked = _rewire(up.unionByName(down), by, size, settings)
    return (
        linked.filter(F.col("near") > F.col("node"))
        .select(*by, F.col("near").alias("high"), F.col("least").alias("low"))
        .distinct()
    )


def _small_star(stars: DataFrame, by: list[str], size: int, settings: Settings) -> DataFrame:
    linked = _rewire(
        stars.select(*by, F.col("high").alias("node"), F.col("low").alias("near")), by, size, settings
    )
    # links that become (x, x) vanish; the node itself always stays linked to its least
    moved = F.array(F.col("near"), F.col("node"))
    return (
        linked.select(*by, F.explode(moved).alias("high"), F.col("least").alias("low"))
        .filter(F.col("high") != F.col("low"))
        .distinct()
    )


def _look(stars: DataFrame, by: list[str]) -> tuple[int, bool]:
    """Number of links, and whether they are final: every node hangs on one
    smaller node that hangs on none."""
    high = stars.select(*by, F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    low = stars.select(*by, F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = high.unionByName(low).groupBy(*by, "node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    loose = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    row = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(loose)).first()
    return row[0], row[1] == 0


def components(edges: DataFrame, by: Sequence[str] = (), settings: Settings = DEFAULTS) -> DataFrame:
    """Map every node of ``edges(a, b)`` to the smallest node of its component.

    Returns ``(by..., node, root)`` for all nodes that have an edge to another
    node. ``by`` keeps graphs of several runs apart.
    """
    by = list(by)
    stars = settle(
        edges.filter(F.col("a") != F.col("b"))
        .select(*by, F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct()
    )
    links, final = _look(stars, by)
    while not final:
        size = 2 * links  # a link has two nodes, and no step adds nodes
        stars = settle(_small_star(_large_star(stars, by, size, settings), by, size, settings))
        links, final = _look(stars, by)
    members = stars.select(*by, F.col("high").alias("node"), F.col("low").alias("root"))
    roots = stars.select(*by, F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return members.unionByName(roots)

"""Connected components by alternating stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of node and neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    edges: longs (u, v), without nulls; loops and repeats do no harm. Each round
    writes its edges to the shared folder and removes the last round's; rounds
    grow with the logarithm of the nodes. Hubs are reduced by partial minima and
    joined by joins that Spark may split. Only counts come to the driver.
    files: of each round's table, see materialise().
    """
    now = materialise(edges.select("u", "v").filter("u <> v").distinct(), files)
    mark = None
    while True:
        new = materialise(_small_star(_large_star(now)), files)
        seen = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now)
        now = new
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen

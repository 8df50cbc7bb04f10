"""Graph algorithms on edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Write = Callable[[DataFrame], DataFrame]


def connected_components(edges: DataFrame, write: Write, drop: Callable[[DataFrame], None] = lambda _: None) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches.

    Alternates the large-star and the small-star step, which needs a number of rounds that grows with the logarithm
    of the nodes, even on long chains. A step is a partial aggregate and a join on nodes; no neighbourhood is ever
    gathered, and a hub's side of the join has one row, so that its edges can be split over tasks. ``write`` cuts the
    lineage, and is given the edges of every round; ``drop`` may delete those of a round that is over. Loops and
    repeated edges are allowed; rows with nulls are left out; no edges give no nodes.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = write(both.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    nodes = edges.filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    last: tuple | None = None
    while True:
        seen = Observation()
        step = _small_star(_large_star(now))
        after = write(step.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        drop(now)
        now, state = after, (seen.get["n"], seen.get["s"])
        if state == last:
            break
        last = state
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours. Edges run from larger to smaller."""
    smallest = e.groupBy("u").agg(F.min("v").alias("m"))  # among smaller neighbours; a node without any is its own
    joined = e.select(F.col("u").alias("w"), F.col("v").alias("u")).join(smallest, "u", "left")
    return joined.select(F.col("w").alias("u"), F.coalesce("m", "u").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its smaller neighbours and itself."""
    smallest = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()

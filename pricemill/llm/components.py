"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricemill.session import stage

ROUNDS = 64


def _least(links: DataFrame) -> DataFrame:
    """The least neighbour of each node, itself included."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    joined = down.join(least, "a")
    moved = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links ``(a, b)``; a component is named by its least node.

    Rounds stop when the links are stars around their least nodes; a chain of n links takes about
    log n rounds. Each round is staged, so the plan does not grow.
    """
    current = stage(links.where("a <> b").select("a", "b").distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        current = stage(_small_star(_large_star(current)).distinct(), "links")
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"links did not settle in {ROUNDS} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stage(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")

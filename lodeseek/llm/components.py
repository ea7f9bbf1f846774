"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    """u, and m: the least of u and its v. Counted before the shuffle, so a node with many neighbours is one row a task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """u and component, the least node that it reaches, for every node of edges (u, v) but the components' own least.

    Each round's edges are written to the shared folder, where the next reads them; rounds end when nothing changes."""
    tag = f"cc-{id(edges)}"
    now = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0")
    mark = None
    for k in range(1, most_rounds + 1):
        new = scratch.save(small_star(large_star(now)), f"{tag}-{k}")
        seen = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{tag}-{k - 1}")
        now = new
        if seen == mark:
            return now.select("u", F.col("v").alias("component"))
        mark = seen
    raise RuntimeError(f"components still changed after {most_rounds} rounds")

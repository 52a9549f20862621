"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrove.workspace import Workspace, broadcast_if_bounded

HUB = 1024  # edges of one node that a task joins at once


def components(edges: DataFrame, work: Workspace, name: str = "edges") -> DataFrame:
    """``node, root`` (root: smallest node reachable) for every node of ``edges(a, b)`` but roots.

    Each step links every node to the smallest neighbour it knows, so the depth of the trees
    falls by about half. A hub's edges are never gathered: its minimum is a partial aggregate, and
    where it meets its edges they are dealt in parts of about ``HUB``. Every step is written to the
    shared folder. Loops and repeated edges do no harm; no edges, no rows.
    """
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    down = work.write(down.filter("u > v").distinct(), f"{name}_0")
    step = 0
    while not _stars(down):
        step += 1
        both = down.union(down.select("v", "u"))
        low = work.write(_least(both), f"{name}_{step}m")
        large = _dealt(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.write(large.filter("u > v").distinct(), f"{name}_{step}l")
        parent = work.write(_least(large), f"{name}_{step}p")
        moved = _dealt(large, parent).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        own = parent.select("u", F.col("m").alias("v"))
        down = work.write(own.union(moved).distinct(), f"{name}_{step}")
    return down.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _least(edges: DataFrame) -> DataFrame:
    """``u, m, parts``: the smallest neighbour, or the node itself, and parts to deal its edges in."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / HUB).cast("int")
    return low.select("u", F.least("u", "m").alias("m"), parts.alias("parts"))


def _dealt(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``u, v, m``: ``edges(u, v)`` with ``low``; a hub's row is copied to each part of its edges."""
    hubs = low.filter("parts > 1").select("u", "parts")
    n = hubs.count()
    if not n:
        return edges.join(low.select("u", "m"), "u")
    salted = edges.join(broadcast_if_bounded(hubs, n), "u", "left")
    salt = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")
    copies = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return salted.select("u", "v", salt.alias("part")).join(copies, ["u", "part"]).select("u", "v", "m")


def _stars(down: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one itself."""
    ends = down.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(down.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()

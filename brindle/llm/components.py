"""Connected components by alternating stars, with a reliable checkpoint each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, MOST_HOT, checkpointed


def _stars(edges: DataFrame, large: bool, hub_links: int) -> DataFrame:
    """Large star: link each greater neighbour to the least of a node's neighbourhood. Small star: each lesser one.

    With ``hub_links``, nodes of more links than that are joined by broadcast.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    hub = F.col("n") > hub_links
    # the least neighbour of a hub is broadcast: hubs are few by their number of links, and no task gets all of one
    hubs = F.broadcast(least.where(hub))
    linked = both.join(hubs, "a").unionByName(both.join(hubs.select("a"), "a", "left_anti").join(least.where(~hub), "a")) if hub_links else both.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its least node.

    Each round rewires the links to the least neighbour (minima are combined before the shuffle and hubs joined by
    broadcast, so a hub is no hot spot) and is checkpointed; the rounds end when no link changes, after about log2 of the longest path.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        # below so many links in all, no node can be a hub
        hub_links = max(HOT_ROWS, mark[0] // MOST_HOT) if mark[0] > HOT_ROWS else 0
        now = checkpointed(_stars(checkpointed(_stars(now, True, hub_links)) if hub_links else _stars(now, True, 0), False, hub_links))
        new = _mark(now)
        if new == mark:
            break
        mark = new
    held = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return held


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

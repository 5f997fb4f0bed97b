"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, join_counted, written


def stars(edges: DataFrame, n_edges: int, large: bool) -> DataFrame:
    """One step: each node's greater (large) or smaller-or-equal neighbours are linked to its least neighbour.

    A hub's links stay spread over the tasks: its least neighbour comes from partial minima and goes back by broadcast."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = written(dealt(least.select("u", F.least("u", "m").alias("m"), "n"), n_edges))
    moved = join_counted(both, least, "u", n_edges * (2 if large else 1))
    if large:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node of its component.

    Each round writes its links to the shared folder; a component of n nodes takes some log n rounds."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    now, before = state(edges), None
    while now[0] and now != before:
        edges = written(dealt(stars(edges, now[0], large=True), now[0]))
        edges = written(dealt(stars(edges, now[0], large=False), now[0]))
        now, before = state(edges), now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Dependency graphs and link graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written


def edges_of(nodes: DataFrame, group: str = "course") -> DataFrame:
    """(group, src, dst) from nodes (group, key, prereqs), between known nodes of one group only."""
    e = nodes.select(group, F.explode("prereqs").alias("src"), F.col("key").alias("dst"))
    return e.join(nodes.select(group, F.col("key").alias("src")), [group, "src"], "left_semi")


def topological(nodes: list[tuple[int, str, list[str]]]) -> list[str]:
    """Kahn's order of (ch, key, prereqs), always the least (ch, key) that is ready; members of cycles are left out."""
    import heapq

    known = {k for _, k, _ in nodes}
    waits = {k: {p for p in ps if p in known} for _, k, ps in nodes}
    chapter = {k: c for c, k, _ in nodes}
    then: dict[str, list[str]] = {}
    for k, ps in waits.items():
        for p in ps:
            then.setdefault(p, []).append(k)
    ready = [(chapter[k], k) for k, ps in waits.items() if not ps]
    heapq.heapify(ready)
    out = []
    while ready:
        _, k = heapq.heappop(ready)
        out.append(k)
        for n in then.get(k, []):
            waits[n].discard(k)
            if not waits[n]:
                heapq.heappush(ready, (chapter[n], n))
    return out


def topological_order(nodes: DataFrame) -> DataFrame:
    """(course, place, key): one bounded graph for each course."""

    def order(pdf):
        import pandas as pd

        keys = topological(list(zip(pdf["ch"].tolist(), pdf["key"].tolist(), [list(p) if p is not None else [] for p in pdf["prereqs"]], strict=True)))
        return pd.DataFrame({"course": [pdf["course"].iloc[0]] * len(keys), "place": range(1, len(keys) + 1), "key": keys})

    return nodes.groupBy("course").applyInPandas(order, "course int, place int, key string")


def bounded_bfs(links: DataFrame, starts: DataFrame, depth: int, follow: Column | None = None) -> DataFrame:
    """(node, depth): the least number of links from starts, up to depth. Each round expands new nodes only and is written,
    so neither lineage nor work grows with the rounds before.

    follow: a condition on dst; other targets are never reached."""
    seen = written(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    links = links if follow is None else links.where(follow)
    for k in range(1, depth + 1):
        new = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def crawl_order(links: DataFrame, start: str, follow: Column, pages: int) -> DataFrame:
    """(node, place, depth): the first pages that a queue visits from start on, each once.

    links: (src, ord, dst), ord the place of a link in its page; follow: a condition on dst. Nodes of one depth come in the
    order of the page that names them first, then of their place in it. A round holds at most pages nodes."""
    spark = links.sparkSession
    links = links.where(follow)
    frontier = spark.createDataFrame([(start, 1, 0)], "node string, place int, depth int")
    seen, n, depth = frontier, 1, 0
    while n < pages:
        depth += 1
        found = links.join(F.broadcast(frontier.select(F.col("node").alias("src"), "place")), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("place", "ord")).alias("by"))
        new = found.join(F.broadcast(seen.select("node")), "node", "left_anti").orderBy("by", "node").limit(pages - n).collect()  # pages rows at most
        if not new:
            break
        frontier = spark.createDataFrame([(r["node"], n + k + 1, depth) for k, r in enumerate(new)], "node string, place int, depth int")
        seen, n = seen.unionByName(frontier), n + len(new)
    return seen

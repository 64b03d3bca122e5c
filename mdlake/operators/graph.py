"""The link graph: a directed multigraph held as an edge table.

A node is a document's path or a link's target as written. Edges are
(source_path, target_path, link_type, anchor_text); parallel edges count.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from . import components as C
from .shared import written


def edges(documents: DataFrame, links: DataFrame) -> DataFrame:
    own = documents.select(F.col("doc_id").alias("source_doc_id"), F.col("path").alias("source_path"))
    return links.join(own, "source_doc_id").select("source_path", F.col("target").alias("target_path"), "link_type", "anchor_text")


def nodes(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(path): every end of an edge, and the paths of ``more``."""
    out = edges.select(F.explode(F.array("source_path", "target_path")).alias("path"))
    if more is not None:
        out = out.unionByName(more.select("path"))
    return out.where("path is not null").distinct()


def add_links(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new)


def remove_document(edges: DataFrame, path: str) -> DataFrame:
    """Without the edges that leave a document; edges to it stay."""
    return edges.where(F.col("source_path") != path)


def get_links(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("source_path") == path)


def get_backlinks(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("target_path") == path)


def stats(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node_count, edge_count)."""
    return nodes(edges, more).agg(F.count(F.lit(1)).alias("node_count")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edge_count"))))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("out_degree"))


def pagerank(edges: DataFrame, more: DataFrame | None = None, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(path, score), best first, after exactly ``rounds`` rounds from equal
    scores. Parallel edges count as often as they are there; the score of nodes
    without edges out is spread over all nodes.

    All nodes without edges in have the same score, a number of each round; what
    they pass on is summed up once, as ``still`` of their targets. So a round
    works on the nodes with edges in and the edges between them alone. These edges
    are partitioned by source once and kept on disk, so a round shuffles scores
    and partial sums by target, but not the edges. Every round's scores are a
    table in the shared folder, from which the next begins."""
    every = written(nodes(edges, more), "nodes")
    n = every.count()
    if not n:
        return every.select("path", F.lit(0.0).alias("score"))
    pair = edges.where("target_path is not null").groupBy("source_path", "target_path").agg(F.count(F.lit(1)).alias("m"))
    total = pair.groupBy("source_path").agg(F.sum("m").alias("out"))
    flow = written(pair.join(total, "source_path").select(F.col("source_path").alias("src"), F.col("target_path").alias("dst"), (F.col("m") / F.col("out")).alias("share")), "flow")
    ends = lambda c: flow.select(F.col(c).alias("path")).distinct()
    fed = ends("dst")
    still = flow.join(fed.withColumnRenamed("path", "src"), "src", "left_anti").groupBy(F.col("dst").alias("path")).agg(F.sum("share").alias("still"))
    base = fed.join(still, "path", "left").join(ends("src").withColumn("has", F.lit(True)), "path", "left")
    base = written(base.select("path", F.coalesce("still", F.lit(0.0)).alias("still"), F.col("has").isNull().alias("dangling")), "ranked")
    alone = n - fed.unionByName(ends("src")).distinct().count()  # nodes without any edge
    flow = flow.join(base.select(F.col("path").alias("src")), "src", "left_semi").repartition("src").persist(StorageLevel.DISK_ONLY)
    now, rest = base.withColumn("score", F.lit(1.0 / n)), 1.0 / n
    try:
        for _ in range(rounds):
            into = flow.join(now.select(F.col("path").alias("src"), "score"), "src").groupBy(F.col("dst").alias("path")).agg(F.sum(F.col("share") * F.col("score")).alias("in"))
            loose = (now.where("dangling").agg(F.sum("score")).first()[0] or 0.0) + alone * rest  # one row
            score = lambda given: (1 - damping) / n + damping * (given + loose / n)  # noqa: B023, E731
            now = written(base.join(into, "path", "left").select("path", "dangling", score(F.coalesce("in", F.lit(0.0)) + F.col("still") * rest).alias("score")), "scores")
            rest = score(0.0)
    finally:
        flow.unpersist()
    found = every.join(now.select("path", "score"), "path", "left").select("path", F.coalesce("score", F.lit(rest)).alias("score"))
    return found.orderBy(F.desc(F.round("score", 12)), "path")


def connected_components(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(path, component): the least path of its weak component."""
    found = C.connected(edges.where("target_path is not null"), "source_path", "target_path")
    return nodes(edges, more).join(found, F.col("path") == F.col("node"), "left").select("path", F.coalesce("root", "path").alias("component"))


def component_members(parts: DataFrame) -> DataFrame:
    """(component, size, path), a row per member whatever the size: components
    largest first, then by first member, members in order."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return parts.join(sizes, "component").select("component", "size", "path").orderBy(F.desc("size"), "component", "path")


def component_lists(parts: DataFrame, most: int = 100_000) -> DataFrame:
    """(component, size, members), largest first, then by first member. A
    component of more than ``most`` nodes has a null list, as a row can't hold
    any number of them; ``component_members`` has them all."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    lists = parts.join(sizes.where(F.col("size") <= most), "component").groupBy("component").agg(F.sort_array(F.collect_list("path")).alias("members"))
    return sizes.join(lists, "component", "left").select("component", "size", "members").orderBy(F.desc("size"), "component")


def shortest_path(edges: DataFrame, start: str, end: str, more: DataFrame | None = None) -> list[str] | None:
    """The nodes of a shortest directed path, the lexicographically least of
    those; None if a node is unknown or there is no path.

    Breadth first from the end over reversed edges, a join per level; each level
    holds (node, next node), the least next node being kept, so that following
    them from the start gives the path, however long it is."""
    spark = edges.sparkSession
    known = nodes(edges, more).where(F.col("path").isin(start, end)).count()
    if known < len({start, end}):
        return None
    if start == end:
        return [start]
    back = written(edges.select(F.col("source_path").alias("src"), F.col("target_path").alias("dst")).where("src <> dst").distinct().repartition("dst"), "reverse")
    seen = spark.createDataFrame([(end, None)], "node string, nxt string")
    front, levels = seen, []
    while True:
        step = back.join(front.select("node"), F.col("dst") == F.col("node")).groupBy("src").agg(F.min("dst").alias("nxt")).select(F.col("src").alias("node"), "nxt")
        front = written(step.join(seen.select("node"), "node", "left_anti"), "front")
        if front.isEmpty():
            return None
        levels.append(front)
        if not front.where(F.col("node") == start).isEmpty():
            break
        seen = seen.unionByName(front)
        if len(levels) % 16 == 0:  # keeps the plan small
            seen = written(seen, "seen")
    path = [start]
    for level in reversed(levels):  # a row of each level
        path.append(level.where(F.col("node") == path[-1]).first()["nxt"])
    return path


def path_rows(edges: DataFrame, start: str, end: str, more: DataFrame | None = None) -> DataFrame:
    """(step, path) of ``shortest_path``; no rows without a path."""
    found = shortest_path(edges, start, end, more)
    return edges.sparkSession.createDataFrame(list(enumerate(found or [])), "step int, path string")

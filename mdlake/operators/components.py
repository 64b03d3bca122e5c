"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import remove, scratch, written


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """(node, root): the least node of the component of every node that has an
    edge.

    Alternates two star operations on the edge table until nothing changes:
    first every node hangs its greater neighbours on its least neighbour, then
    every node hangs its smaller neighbours (and itself) on the least of them.
    The number of rounds grows with the logarithm of the diameter, and a round
    shuffles the edges twice; no table of all neighbours of a node is built, so
    a hub does no harm beyond its own rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    with scratch() as old:
        e = written(e, "graph")
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        with scratch() as new:
            e = written(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "graph")
        remove(edges.sparkSession, old)
        old = new
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components didn't settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

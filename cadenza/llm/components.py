"""Connected components by alternating large-star and small-star rounds, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = written(out.distinct(), "large")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
    discard(least)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge table (u, v), the component named by its smallest node.

    Loops and repeated edges do no harm, null ends are left out; nodes without edges don't appear.
    A hub with a third of all edges is pre-aggregated before each shuffle. Minima are written before they are
    joined, so that both sides of the join are plain shuffles, of which adaptive execution splits the hub's.
    Every round is written to the shared folder.
    """
    edges = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    nodes = edges.select("u").union(edges.select("v")).distinct()
    before = None
    for _ in range(rounds):
        large = _large_star(edges)
        star = _small_star(large)
        discard(large, *([edges] if before is not None else []))  # the first table also names the nodes
        edges = star
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return (
        nodes.select(F.col("u").alias("node"))
        .join(edges.select(F.col("u").alias("node"), "v"), "node", "left")
        .select("node", F.coalesce("v", "node").alias("component"))
    )

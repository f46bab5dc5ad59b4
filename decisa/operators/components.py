"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisa.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Minima are pre-aggregated and joined back, so no node's neighbours meet in one row."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = both.filter(F.col("b") < F.col("a"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    hooked = down.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node.

    Null ends, loops and repeated edges are ignored. Each round is written to the shared folder; it ends when a
    round changes no edge.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    edges = materialize(edges.distinct(), "edges")
    state = None
    for _ in range(rounds):
        stars = _star(_star(edges, True).distinct(), False).distinct().filter(F.col("a") != F.col("b"))
        edges = materialize(stars, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

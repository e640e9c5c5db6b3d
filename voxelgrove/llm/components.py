"""Connected components of a graph given as an edge table, by alternating stars: no part of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Rounds grow with the logarithm of the nodes; more than these mean a mistake.
MOST_ROUNDS = 200
#: A node with more neighbours is a hub: its least neighbour is found by partial aggregation and handed out by broadcast, so that no task gets all its rows.
HUB = 1 << 16
#: Hubs at most, so that what is broadcast has a bound: where there are many edges, a hub needs more neighbours.
MOST_HUBS = 100_000


def _least(pairs: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``pairs`` (u, v) with m, the least of u and its neighbours: one shuffle of the rows of other nodes than hubs, none of the hubs' rows."""

    def of_task(rows: DataFrame) -> DataFrame:
        return rows.select("u", "v", F.least(F.col("u"), F.min("v").over(Window.partitionBy("u"))).alias("m"))

    if hubs is None:
        return of_task(pairs)
    few = F.broadcast(hubs.withColumnRenamed("node", "u"))
    apart = pairs.join(few, "u", "left_semi")
    least = apart.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return of_task(pairs.join(few, "u", "left_anti")).unionByName(apart.join(F.broadcast(least), "u").select("u", "v", "m"))


def _both(a: str, b: str) -> Column:
    """Two rows of one: (a, b) and (b, a)."""
    return F.inline(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))


def _large_star(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    return _least(edges.select(_both("a", "b")), hubs).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. edges: a < b. A node has no more of them than neighbours before the large star, so the hubs are the same."""
    found = _least(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), hubs)
    return found.select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).where("a <> b").select("a", "b")


def contract(edges: DataFrame, name: str = "components", hub: int = HUB) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of the component.

    Rounds of a large star and a small star keep the components and end in stars around the least nodes, which a further round leaves as they are; the
    number of rounds grows with the logarithm of the nodes. The loop runs until nothing changes and raises if it never does. Nodes with more than ``hub``
    neighbours take another way to the same result.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}_edges_0")
    for k in range(1, MOST_ROUNDS + 1):
        # Stars: no node is both a centre and a leaf, and each leaf has one centre.
        ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(1).alias("leaf")))))
        nodes = ends.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least"), F.count("*").alias("many"))
        loose, many, most = nodes.agg(F.count_if(F.expr("n > 1 or (n = 1 and least = 0)")), F.sum("many"), F.max("many")).first()
        if not loose:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        bound = max(hub, many // MOST_HUBS)
        hubs = written(nodes.where(F.col("many") > bound).select("node"), f"{name}_hubs_{k}") if most > bound else None
        after = written(_small_star(_large_star(e, hubs).distinct(), hubs).distinct(), f"{name}_edges_{k}")
        dropped(e, hubs)
        e = after
    raise RuntimeError(f"the components are not found after {MOST_ROUNDS} rounds")

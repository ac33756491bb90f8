"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round replaces edges by edges to the least neighbour (first of the greater neighbours of each node, then of the
smaller ones); the graph's components stay, its edges end as one star for each component. Least neighbours are found by
aggregation, which combines on the map side, and given back by a join that adaptive execution can split, so a node with
very many neighbours makes no large task. Each round is written, so a lost executor costs no more than the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of each node that has an edge and is not its component's least.

    edges: a, b of one orderable type. Loops, repeated edges and edges with a null are of no consequence.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(down, "edges"), None
    while True:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38)))")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now

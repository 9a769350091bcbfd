"""Connected components of an edge table, by alternating large-star and small-star steps.

Only edges move. A node's smallest neighbour is found by partial aggregation and joined back to the node's edges, where Spark splits
the edges of a hub over tasks. The edges are written to the shared folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.support import materialize, with_totals


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours. Some edges may come twice."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = with_totals(both, "a", m=F.min(F.least("a", "b")))
    return known.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges go from larger (a) to smaller (b)."""
    known = with_totals(edges, "a", m=F.min("b"))
    ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return known.select(F.inline(ends)).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """No smaller end of an edge has a smaller neighbour itself, and no node has two."""
    hung = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return hung.isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns); the component is its smallest node.

    Nulls and loops link nothing, repeated edges count once. No edges give no rows.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    while not _settled(now):
        now = materialize(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

"""Connected components of an edge table, by alternating large and small stars.

Each round gives every node its smallest neighbour: a grouped minimum (combined
on the map side) joined back to the edges, so a node of any degree is only ever
a key of plain aggregations and equi-joins.  Rounds are stored, which cuts the
lineage; they end when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours link to the smallest one; small: a node and its smaller neighbours do."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # stored, so that both sides of the join are shuffled on their own and a hub's rows can be split (skew join)
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns a, b); the root is the smallest node of its component."""
    edges, before = stored(edges.where("a <> b").select("a", "b")), None
    while True:
        edges = stored(_stars(_stars(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()

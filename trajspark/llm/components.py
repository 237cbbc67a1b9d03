"""Connected components of a graph given as pairs, by alternating large and small stars, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are tied to the least of them and it. Large: only greater neighbours; small: only lesser ones."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge (a, b): the root is the least node that it is connected with.

    Rows with nulls and loops tie nothing. Each round is written to the shared folder, so that no lost executor costs
    more than a round. An isolated node isn't in the result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = materialise(now, "edges"), None
    for _ in range(rounds):
        then = materialise(_star(_star(now, True), False), "edges")
        drop_scratch(now)
        now = then
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

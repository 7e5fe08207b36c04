"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.session import materialise

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one (or to itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the smallest of them. Rows have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component): for each node with a link, the smallest node it is connected with.

    ``edges`` has two columns of longs; loops, repeated rows and either direction are allowed. Links are turned into
    stars around the smallest node by joins and minima, so no node's links are ever gathered in one place. Each round
    is written to the shared folder, which also cuts the lineage.
    """
    a, b = edges.columns
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    current, before = materialise(clean, label), None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before or state[0] == 0:
            break
        before = state
        current = materialise(_small_star(_large_star(current).distinct()).distinct(), label)
    else:
        raise RuntimeError("components did not settle")
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(members.select("component", "component").distinct())

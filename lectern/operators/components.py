"""Connected components of a graph given as a table of edges.

Large-star and small-star steps alternate until nothing changes (a logarithmic number of rounds in practice).
Minima are combined before the shuffle and joined back, so a node with very many edges is never one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v): large joins the greater neighbours of u to its least, small u and the lesser ones."""
    if large:
        sided = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sided.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sided.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node of its component.

    Edges with a null end and loops count for nothing, repeated edges once; no edges give no rows.
    """
    now = stored(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = None
    while True:
        now = stored(_star(_star(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Exclusive greedy assignment: each claimant in turn takes its nearest target that is still free."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import stored


def greedy_assign(pairs: DataFrame, claimant: str, order: str, target: str, distance: str) -> DataFrame:
    """(claimant, target) as a walk through the claimants by ``order`` would give them.

    Settled in rounds instead: a claimant's nearest free target is its own once no earlier claimant that is
    still open could take it; whatever was taken goes from all other pairs. Ties in distance go to the lower
    target, ``order`` must be unique. Rows with a null in any column count for nothing.
    """
    open_ = stored(pairs.select(F.col(claimant).alias("c"), F.col(order).alias("o"), F.col(target).alias("t"), F.col(distance).alias("d")).dropna())
    taken: list[DataFrame] = []
    while not open_.isEmpty():
        wants = open_.groupBy("c", "o").agg(F.min(F.struct("d", "t")).alias("m")).select("c", "o", F.col("m.t").alias("t"))
        first = open_.groupBy("t").agg(F.min("o").alias("first"))
        won = stored(wants.join(first, "t").where("o = first").select("c", "t"))
        taken.append(won)
        open_ = stored(open_.join(won.select("c"), "c", "left_anti").join(won.select("t"), "t", "left_anti").select("c", "o", "t", "d"))
    return reduce(DataFrame.unionByName, taken, open_.select("c", "t")).select(F.col("c").alias(claimant), F.col("t").alias(target))

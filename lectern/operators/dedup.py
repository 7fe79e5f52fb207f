"""Greedy de-duplication on two keys, as a list walk would do it, without the walk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import stored


def greedy_dedup(df: DataFrame, pos: str, keys: tuple[str, str]) -> DataFrame:
    """(pos) of the rows kept: a row goes if an earlier kept row has one of its keys.

    A row that goes does not register its keys, so this is not a grouping: it is settled in rounds. In each,
    rows that are first under all their keys are kept, and rows that share a key with a kept one go. Null and
    empty keys never meet; ``pos`` must be unique, rows without it are left out. Chains of rows that exclude
    each other in turn take a round per link; usual data take three or four.
    """
    a, b = keys
    open_ = stored(df.where(F.col(pos).isNotNull()).select(F.col(pos).alias("pos"), F.nullif(a, F.lit("")).alias("a"), F.nullif(b, F.lit("")).alias("b")))
    kept: list[DataFrame] = []
    while not open_.isEmpty():
        first = {k: open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("pos").alias(f"first_{k}")) for k in "ab"}
        marked = open_.join(first["a"], "a", "left").join(first["b"], "b", "left")
        keeps = stored(marked.where((F.coalesce("first_a", "pos") == F.col("pos")) & (F.coalesce("first_b", "pos") == F.col("pos"))).select("pos", "a", "b"))
        kept.append(keeps.select("pos"))
        rest = open_.join(keeps.select("pos"), "pos", "left_anti")
        for k in "ab":
            rest = rest.join(keeps.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        open_ = stored(rest.select("pos", "a", "b"))
    return reduce(DataFrame.unionByName, kept, open_.select("pos")).select(F.col("pos").alias(pos))

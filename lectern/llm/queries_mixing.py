"""Queries that mix the documents' sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.mixing import draw
from lectern.llm.packing import PackOptions, token_counts
from lectern.session import table


def _mix(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    items = token_counts(table(spark, root, "documents"), "doc_id", "text", PackOptions(), keep=("source",))
    return draw(items, "doc_id", table(spark, root, "mix_targets"))


def p8_draws(spark: SparkSession, root: str) -> DataFrame:
    """The draws of the mix in its order."""
    draws, _ = _mix(spark, root)
    return draws.select("source", "doc_id", F.col("repeat").alias("repeat_no"), F.col("tokens").alias("n_tokens"), F.round("position", 9).alias("position"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of each source that was reached beside its target."""
    _, shares = _mix(spark, root)
    return shares.select("source", "target_share", F.round("reached_share", 6).alias("reached_share"), F.col("tokens").alias("source_tokens"), "drawn_tokens", F.col("draws").alias("n_draws"), F.col("repeats").alias("n_repeats"), F.col("met").alias("target_met"))


QUERIES = {"p8_draws": p8_draws, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}

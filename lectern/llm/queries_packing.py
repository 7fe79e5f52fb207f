"""Queries that fill containers with the documents' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.packing import PackOptions, fill, token_counts
from lectern.session import stored, table


def _packed(spark: SparkSession, root: str) -> DataFrame:
    options = PackOptions()
    items = token_counts(table(spark, root, "documents"), "doc_id", "text", options)
    return fill(items, table(spark, root, "token_budgets"), "doc_id", options)


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of each document, or of each piece of one above the capacity, for every budget."""
    return _packed(spark, root).select("budget_name", "doc_id", "piece", "first_token", F.col("tokens").alias("n_tokens"), "loss_tokens", "container")


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers of each budget are."""
    packed = stored(_packed(spark, root))
    each = packed.groupBy("budget_name", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("segments"))
    budgets = table(spark, root, "token_budgets").select("budget_name", "capacity_tokens").distinct()
    return (
        each.join(budgets, "budget_name")
        .groupBy("budget_name", "capacity_tokens")
        .agg(
            F.count("*").alias("n_containers"),
            F.sum("used").alias("n_tokens"),
            F.max("used").alias("fullest"),
            F.max("segments").alias("most_segments"),
            F.round(F.sum("used") / F.sum("capacity_tokens"), 6).alias("filled_part"),
        )
    )


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}

"""Queries over long exact spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.spans import SharedSpans, shared_spans, sharing_pairs, stretches
from lectern.session import table


def _found(spark: SparkSession, root: str) -> SharedSpans:
    return shared_spans(table(spark, root, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of documents with at least 160 consecutive code points in common."""
    return sharing_pairs(_found(spark, root)).select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p9_stretches(spark: SparkSession, root: str) -> DataFrame:
    """The stretches of each document that stand in another one."""
    return stretches(_found(spark, root)).select(F.col("doc").alias("doc_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Of each document, the characters and the part shared with others; its class of equal texts."""
    found = _found(spark, root)
    shared = stretches(found).groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count("*").alias("n_stretches"))
    docs = table(spark, root, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    return (
        docs.join(shared, F.col("doc_id") == F.col("doc"), "left")
        .join(found.copies.select(F.col("doc").alias("_doc"), "rep"), F.col("doc_id") == F.col("_doc"), "left")
        .select(
            "doc_id",
            F.coalesce("rep", "doc_id").alias("class_id"),
            "n_chars",
            F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
            F.coalesce("n_stretches", F.lit(0)).alias("n_stretches"),
            F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("shared_part"),
        )
    )


QUERIES = {"p9_found": p9_found, "p9_stretches": p9_stretches, "p9_shares": p9_shares}
#: All windows of all texts in SQL: exact, and quick enough at the size where the comparison is made.
P9_FOUND_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 160),
w AS (SELECT doc_id, unnest(range(1, length(text) - 158)) AS pos, text FROM d),
h AS (SELECT DISTINCT doc_id, md5(substr(text, pos, 160)) AS win FROM w)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM h a JOIN h b ON a.win = b.win AND a.doc_id < b.doc_id"""
ORACLES = {"p9_found": P9_FOUND_SQL}

"""Queries that split the library's long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.pieces import PieceOptions, split_oversized
from lectern.session import table


def _pieces(spark: SparkSession, root: str, with_text: bool) -> DataFrame:
    limit = PieceOptions().limit
    # repeated rows go before they are cut, and only those that will be
    elements = table(spark, root, "page_elements").select("elem_pk", "text").where(F.length("text") > limit).distinct()
    texts = table(spark, root, "pdf_texts").select("pdf_id", "full_text", "pdf_path").where(F.length("full_text") > limit).distinct()
    reached = table(spark, root, "zotero_items").select("pdf_path").where("pdf_path <> ''").distinct()
    one = split_oversized(elements, "elem_pk", "text", with_text=with_text)
    two = split_oversized(texts, "pdf_id", "full_text", with_text=with_text, keep=("pdf_path",)).join(reached, "pdf_path", "left_semi")
    rest = ["piece", "start", "end", "cut", "hard", *(["content"] if with_text else [])]
    return one.select(F.lit("page_elements").alias("holder"), F.col("elem_pk").alias("holder_id"), *rest).unionByName(
        two.select(F.lit("pdf_texts").alias("holder"), F.col("pdf_id").alias("holder_id"), *rest)
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The texts that had to be split, and whether one had a stretch without any natural place for a cut."""
    return _pieces(spark, root, False).groupBy("holder", "holder_id").agg(F.max("hard").alias("hard"))


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """All pieces in order with their offsets."""
    return _pieces(spark, root, True).select("holder", "holder_id", "piece", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "cut", "content")


P2_FOUND_SQL = r"""
WITH t AS (
  SELECT 'page_elements' AS holder, elem_pk AS holder_id, text FROM page_elements WHERE length(text) > 1200
  UNION ALL
  SELECT 'pdf_texts', pdf_id, full_text FROM pdf_texts WHERE length(full_text) > 1200
    AND pdf_path IN (SELECT pdf_path FROM zotero_items WHERE pdf_path <> ''))
SELECT holder, holder_id, max((list_max(list_transform(
  regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?;。！？；]'), lambda x: length(x))) > 1200)::BIGINT) AS hard
FROM t GROUP BY holder, holder_id"""

QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
ORACLES = {"p2_found": P2_FOUND_SQL}

"""Queries that repair text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.scans import defects, find_noise, paragraphs
from lectern.session import table


def _elements(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "page_elements").select("elem_pk", "doc_key", "page", "element_id", "element_type", "text")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The defects of every element."""
    return defects(find_noise(_elements(spark, root)))


def p5_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """Continuous clean paragraphs of each document, in order of page and place."""
    elements = _elements(spark, root)
    found = paragraphs(elements, find_noise(elements))
    return found.select("doc_key", "page", F.col("n").alias("place"), "first_pk", "n_elements", "text")


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
ORACLES: dict[str, str] = {}

"""Queries over the names of authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.names import name_groups
from lectern.session import stored, table


def _authors_of_line(line: Column) -> Column:
    """The authors of a line: parted by semicolons where there are any, else by commas; no closing et al."""
    named = F.regexp_replace(line, r"(?i)[,;]?\s*\bet\s+al\.?\s*$", "")
    return F.split(named, F.when(F.contains(named, F.lit(";")), F.lit(";")).otherwise(F.lit(",")))


def spellings(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "zotero_items").select(F.explode("authors").alias("name"))
    papers = table(spark, root, "external_papers").where("authors <> ''").select(F.explode(_authors_of_line(F.col("authors"))).alias("name"))
    # trimmed of all white space, not of blanks only
    edge = F.regexp_replace("name", r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", "")
    return items.union(papers).select(edge.alias("name")).where("name <> ''")


def _groups(spark: SparkSession, root: str) -> DataFrame:
    return stored(name_groups(spellings(spark, root), table(spark, root, "nickname_hints")))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of different spellings of one person or organisation."""
    groups = _groups(spark, root)
    a, b = (groups.select("entity", F.col("name").alias(f"name_{x}")) for x in "ab")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every spelling with the number of its person or organisation and the group's least spelling."""
    groups = _groups(spark, root)
    least = groups.groupBy("entity").agg(F.min("name").alias("entity_name"), F.count("*").alias("n_spellings"))
    return groups.join(least, "entity").select("name", "entity_name", "n_spellings")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
ORACLES: dict[str, str] = {}

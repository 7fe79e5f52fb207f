"""Queries that match library items with papers from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.match import FEATURES, MatchOptions, match, prepare, with_copies, works
from lectern.session import stored, table

#: A record is numbered by its table's id times two, plus its side.
PAPER, ITEM = 0, 1
# Kinds of library item that are no works.
_NO_WORKS = ("attachment", "note", "annotation")


def paper_records(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "external_papers").where("paper_id is not null")
    return t.select(
        (F.col("paper_id") * 2 + PAPER).alias("rid"),
        F.lit(PAPER).alias("side"),
        "title",
        F.col("authors").alias("names"),
        F.col("pub_year").alias("year"),
        "doi",
        "abstract",
        "pmid",
        F.col("arxiv_id").alias("preprint"),
        F.col("journal").alias("venue"),
    )


def item_records(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "zotero_items").where("item_id is not null")
    no_work = F.lower(F.trim(F.coalesce("item_type", F.lit("")))).isin(*_NO_WORKS)
    none = F.lit(None).cast("string")
    rows = t.where(~no_work).select(
        (F.col("item_id") * 2 + ITEM).alias("rid"),
        F.lit(ITEM).alias("side"),
        "title",
        F.array_join("authors", "; ").alias("names"),
        F.col("pub_year").alias("year"),
        "doi",
        "abstract",
        none.alias("pmid"),
        none.alias("preprint"),
        F.col("publication").alias("venue"),
    )
    return rows.distinct()  # repeated rows are alike in everything


def _id(rid: Column) -> Column:
    return F.shiftright(rid, 1)


def _both(spark: SparkSession, root: str, options: MatchOptions) -> tuple[DataFrame, DataFrame]:
    records = stored(prepare(paper_records(spark, root).unionByName(item_records(spark, root))))
    return records, match(records, options)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Library items and papers that are about one work."""
    options = MatchOptions()
    records, scored = _both(spark, root, options)
    of = works(records, scored, options)
    items = of.where(F.col("rid") % 2 == ITEM).select(F.col("rid").alias("i"), "work")
    papers = of.where(F.col("rid") % 2 == PAPER).select(F.col("rid").alias("p"), "work")
    return items.join(papers, "work").select(_id(F.col("i")).alias("item_id"), _id(F.col("p")).alias("paper_id")).distinct()


def p6_confidence(spark: SparkSession, root: str) -> DataFrame:
    """The confidence of every item and paper that were compared, with their similarities."""
    options = MatchOptions()
    records, scored = _both(spark, root, options)
    across = with_copies(scored, records, options).where(F.col("a") % 2 != F.col("b") % 2)
    item, paper = (F.when(F.col("a") % 2 == side, F.col("a")).otherwise(F.col("b")) for side in (ITEM, PAPER))
    return across.select(_id(item).alias("item_id"), _id(paper).alias("paper_id"), F.round("gamma", 6).alias("confidence"), *(F.round(f, 4).alias(f"{f}_similarity") for f in FEATURES))


QUERIES = {"p6_found": p6_found, "p6_confidence": p6_confidence}
ORACLES: dict[str, str] = {}

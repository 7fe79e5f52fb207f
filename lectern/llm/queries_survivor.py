"""Queries that build one record per work from its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.match import MatchOptions, match, prepare, works
from lectern.llm.queries_match import paper_records
from lectern.llm.survivor import best_text, most_trusted
from lectern.session import stored, table

#: Weight of a source's word where texts are elected.
_TRUST = {"pubmed": 1.5, "openalex": 1.0, "arxiv": 1.0}


def _grouped(spark: SparkSession, root: str) -> DataFrame:
    """All rows of works with two rows or more, with the work's group_id."""
    options = MatchOptions()
    records = stored(prepare(paper_records(spark, root)))
    of = works(records, match(records, options), options)
    # the work is named by its least rid, which orders like paper_id
    ids = of.select(F.shiftright("rid", 1).alias("paper_id"), F.shiftright("work", 1).alias("group_id"))
    several = ids.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return stored(table(spark, root, "external_papers").join(ids.join(several, "group_id"), "paper_id"))


_ALL = ("pmid", "cited_by", "abstract", "title", "authors", "doi", "journal", "pub_year", "arxiv_id", "url")


def _fields(rows: DataFrame, wanted: tuple[str, ...], with_text: bool = True) -> DataFrame:
    source = F.lower(F.trim("source"))
    digits = F.regexp_extract("pmid", r"([0-9]{5,})", 1)
    late = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    own = F.when(source == "pubmed", 2).otherwise(1)
    doi = F.rtrim(F.regexp_extract(F.lower("doi"), r"(10\.[0-9]{4,9}/\S+)", 1), F.lit("/"))
    proper = F.when(doi.rlike("/.*[0-9]") & ~doi.contains("/pre."), doi)
    said = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
    year = F.regexp_extract("pub_year", r"((?:19|20)[0-9]{2})", 1)
    trust = F.when(source == "pubmed", 3).when(source == "openalex", 2).otherwise(1)
    zero = F.lit(0)
    simple = {
        "pmid": (F.col("pmid"), digits, own, late),
        "cited_by": (F.col("cited_by"), F.when((F.col("cited_by") > 0) & (source == "openalex"), F.col("cited_by")), F.coalesce(late, zero), F.col("cited_by")),
        "doi": (F.col("doi"), proper, zero, late),
        "journal": (F.col("journal"), said("journal"), zero, late),
        "pub_year": (F.col("pub_year"), year, trust, late),
        "arxiv_id": (F.col("arxiv_id"), F.regexp_extract("arxiv_id", r"([0-9]{4}\.[0-9]{4,5})", 1), zero, late),
        "url": (F.col("url"), said("url"), trust, late),
    }
    chosen = most_trusted(rows, "group_id", {k: v for k, v in simple.items() if k in wanted}, "paper_id")
    weight = F.coalesce(F.create_map(*(x for k, v in _TRUST.items() for x in (F.lit(k), F.lit(v))))[source], F.lit(1.0))
    weighed = rows.withColumn("_weight", weight)
    for field, stand_in in (("abstract", 40), ("title", 3), ("authors", 3)):
        if field not in wanted:
            continue
        source_text = weighed if field == "abstract" else weighed.withColumn(field, F.concat(F.regexp_replace(field, r"\.\s*$", ""), F.lit(".")))
        best = best_text(source_text.select("group_id", "paper_id", field, "_weight"), "group_id", field, "paper_id", "_weight", 5 if field == "abstract" else 1 << 40, stand_in, with_text)
        value = F.col(field) if with_text else F.lit(None).cast("string")
        chosen = chosen.unionByName(best.select("group_id", F.lit(field).alias("field"), "paper_id", value.alias("value")))
    return chosen


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Of each work with two rows or more, the rows that supply pmid, cited_by and abstract."""
    rows = _grouped(spark, root)
    return _fields(rows, ("pmid", "cited_by", "abstract"), False).select("group_id", F.col("field").alias("field_name"), "paper_id")


def p3_records(spark: SparkSession, root: str) -> DataFrame:
    """One record per work, each field with the row its value came from."""
    wide = _fields(_grouped(spark, root), _ALL).groupBy("group_id").pivot("field", list(_ALL)).agg(F.first("value").alias("value"), F.first("paper_id").alias("row"))
    return wide.select("group_id", *(F.col(f"{f}_{x}").alias(f if x == "value" else f"{f}_from") for f in _ALL for x in ("value", "row")))


QUERIES = {"p3_found": p3_found, "p3_records": p3_records}
ORACLES: dict[str, str] = {}

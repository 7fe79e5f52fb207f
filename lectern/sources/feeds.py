"""Readers of the record formats that services and stores deliver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARTICLE = """MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>,
Abstract: struct<AbstractText: array<string>>, AuthorList: struct<Author: array<struct<LastName: string, Initials: string, CollectiveName: string>>>>>"""
_WORK = "struct<id: string, title: string, doi: string, publication_year: int, cited_by_count: int, ids: struct<pmid: string>, abstract_inverted_index: map<string, array<int>>, authorships: array<struct<author: struct<display_name: string>>>>"


def _short_list(names: Column) -> Column:
    """Five names at most, then et al."""
    return F.concat(F.array_join(F.slice(names, 1, 5), ", "), F.when(F.size(names) > 5, " et al.").otherwise(""))


def read_json_store(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, corrupt) rows of JSON documents; a corrupt one is kept as text, never lost."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).where("trim(value) <> ''").withColumn("row", parsed)
    return rows.where("row._corrupt is null").select("row.*").drop("_corrupt"), rows.where("row._corrupt is not null").select("value")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Records of an article set in XML: labelled abstracts joined, the year from either form of date."""
    rows = spark.read.schema(_ARTICLE).option("rowTag", "PubmedArticle").xml(path)
    a = "MedlineCitation.Article"
    people = F.transform(F.coalesce(F.col(f"{a}.AuthorList.Author"), F.array()), lambda p: F.coalesce(p["CollectiveName"], F.concat_ws(" ", p["LastName"], p["Initials"])))
    date = F.coalesce(F.col(f"{a}.Journal.JournalIssue.PubDate.Year"), F.regexp_extract(F.col(f"{a}.Journal.JournalIssue.PubDate.MedlineDate"), r"(\d{4})", 1))
    return rows.select(
        F.col("MedlineCitation.PMID").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), _short_list(people).alias("authors"), date.alias("pub_year"),
        F.col(f"{a}.Journal.Title").alias("journal"), F.array_join(F.col(f"{a}.Abstract.AbstractText"), "\n").alias("abstract"), F.lit("pubmed").alias("source"),
    )


def abstract_of_index(index: Column) -> Column:
    """The text of an inverted index (word to positions)."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda p: p["word"]), " ")


def works_of_json(df: DataFrame, raw: str) -> DataFrame:
    """Records of works in JSON; those without a title are left out."""
    w = df.select(F.from_json(raw, _WORK).alias("w")).where("trim(w.title) <> ''")
    people = F.transform(F.coalesce("w.authorships", F.array()), lambda x: x["author"]["display_name"])
    return w.select(
        F.regexp_extract("w.ids.pmid", r"(\d+)$", 1).alias("pmid"), F.col("w.title").alias("title"), _short_list(people).alias("authors"), F.col("w.publication_year").cast("string").alias("pub_year"),
        F.col("w.doi").alias("doi"), F.coalesce(abstract_of_index(F.col("w.abstract_inverted_index")), F.lit("")).alias("abstract"), F.coalesce("w.cited_by_count", F.lit(0)).alias("cited_by"), F.lit("openalex").alias("source"),
    )

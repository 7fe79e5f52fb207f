"""Exports: tagged blocks and tables for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def ris_block() -> Column:
    """One paper's tagged block; tags without a value are left out, each author has a tag."""
    tag = lambda t, c: F.when(T.text(c) != "", F.concat(F.lit(f"{t}  - "), c))
    people = F.transform(T.ris_authors("authors"), lambda a: F.concat(F.lit("AU  - "), a))
    lines = F.concat(
        F.array(F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), T.text("title"))),
        people,
        F.array(tag("PY", "pub_year"), tag("JO", "journal"), tag("AB", "abstract"), tag("DO", "doi"), tag("UR", "url"), tag("ID", "pmid"), F.lit("ER  - ")),
    )
    return F.array_join(F.array_compact(lines), "\n")


def write_ris(papers: DataFrame, path: str) -> None:
    papers.select(ris_block().alias("value")).write.mode("overwrite").text(path)


def write_csv(papers: DataFrame, columns: list[str], path: str) -> None:
    """Columns with a header line, quoted where needed."""
    papers.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

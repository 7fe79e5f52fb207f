"""Lexical retrieval: BM25 over a table of texts, with the overlap fallback for tiny corpora."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


@dataclass(frozen=True)
class Bm25:
    """Okapi weights; negative inverse frequencies are raised to ``floor`` times the mean of all."""

    k1: float = 1.5
    b: float = 0.75
    floor: float = 0.25


def bm25(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, top: int, weights: Bm25 = Bm25()) -> DataFrame:
    """(query_key, key, score, rank) of the ``top`` texts of each query; scores of nothing or less are no hits.

    Ties go to the lower key. All queries are answered by one plan: the corpus is tokenised once, its postings
    are cut to the queries' words before they are joined. Where no text scores above 0 the number of distinct
    words in common takes the score's place. Null texts are empty; empty queries have no hits.
    """
    docs = corpus.select(F.col(key).alias("id"), T.tokens(text).alias("words"))
    asked = queries.select(F.col(query_key).alias("q"), F.explode(T.tokens(query)).alias("w"))
    size = docs.agg(F.count("*").alias("total"), F.avg(F.size("words")).alias("mean_length"))
    postings = docs.select("id", F.size("words").alias("length"), F.explode("words").alias("w")).groupBy("id", "length", "w").agg(F.count("*").alias("tf"))
    raw = postings.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).withColumn("raw", F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # one row
    mean = raw.agg(F.avg("raw").alias("mean_raw"))
    wanted = asked.select("w").distinct()
    idf = raw.join(wanted, "w", "left_semi").crossJoin(F.broadcast(mean)).select("w", "mean_length", F.when(F.col("raw") < 0, weights.floor * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))  # one row
    weighted = postings.join(wanted, "w", "left_semi").join(idf, "w")
    part = F.col("idf") * F.col("tf") * (weights.k1 + 1) / (F.col("tf") + weights.k1 * (1 - weights.b + weights.b * F.col("length") / F.col("mean_length")))
    scored = asked.join(weighted.select("w", "id", part.alias("part")), "w").groupBy("q", "id").agg(F.sum("part").alias("bm25"), F.countDistinct("w").alias("common"))
    best = scored.withColumn("top", F.max("bm25").over(Window.partitionBy("q")))
    score = F.when(F.col("top") > 0, F.col("bm25")).otherwise(F.col("common").cast("double"))
    hits = best.select("q", "id", score.alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("q").alias(query_key), F.col("id").alias(key), F.round("score", 3).alias("score"), "rank")

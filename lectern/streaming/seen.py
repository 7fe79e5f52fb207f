"""Streams of papers: what was not seen before, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import text as T


def push_unseen(papers: DataFrame, seen_path: str, feed_path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the feed what the table of seen keys lacks, batch by batch, and the keys to that table.

    Both are written under the batch's number, so a batch that is run again after a loss overwrites what it
    wrote and finds only the keys of batches before it.
    """

    def one(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("identity", T.paper_key(F.col("doi"), F.col("pmid"), F.col("arxiv_id"), F.col("title"))).where("identity <> ''")
        first = keyed.groupBy("identity").agg(F.min("paper_id").alias("paper_id"))
        spark = batch.sparkSession
        try:
            old = spark.read.option("basePath", seen_path).parquet(seen_path).where(F.col("batch") < number).select("identity")
            fresh = first.join(old, "identity", "left_anti")
        except Exception as error:  # before the first batch there is no table
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
            fresh = first
        fresh = fresh.persist()
        try:
            fresh.write.mode("overwrite").parquet(f"{feed_path}/batch={number}")
            fresh.select("identity").write.mode("overwrite").parquet(f"{seen_path}/batch={number}")
        finally:
            fresh.unpersist()

    return papers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per kind and window of event time; what comes later than ``late`` is dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

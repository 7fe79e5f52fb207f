"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Without this a union of differently partitioned plans below a join fails to be planned in Spark 4.1.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def prepared(spark: SparkSession) -> SparkSession:
    """A session made elsewhere, with the settings the plans here rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults every plan here is written for (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | SETTINGS
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lectern-checkpoint-")
    context.setCheckpointDir(own)
    return own


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors.

    Parquet rather than checkpoint(), as it is compressed and later reads are column-pruned. The files
    are deleted when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{os.getpid()}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

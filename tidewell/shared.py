"""The folder that the driver and all executors share, for tables and trees that live as long as an application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset and Spark runs in this process alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder."""
    return f"{root(spark)}/{tag}-{uuid.uuid4().hex}"


def table(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once and read back, which cuts its lineage and outlives any executor."""
    return placed(df, place(df.sparkSession, tag))


def placed(df: DataFrame, path: str) -> DataFrame:
    """`df` written to a path and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""Tables in the folder that driver and executors share, to cut lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine without it, as in tests, gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration: each is written before the one it was made from is removed, so the folder holds two at most."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what, self.held = spark, what, None

    def saved(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, self.what)
        df.write.parquet(path)
        if self.held:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.held)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.held = path
        return self.spark.read.schema(df.schema).parquet(path)

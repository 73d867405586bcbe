"""Cutting lineage and folders of the shared store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only on a local master, where that is unset (tests), one is made."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that does not exist yet, in the shared store."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors take nothing with them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The state of an iteration, written as a table in the shared folder each round; the round before goes.

    Unlike a checkpoint, a table that is read again brings its own size: the sizes that Spark estimates for joins of checkpoints
    multiply from round to round, until planning takes longer than the jobs.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.last = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        path, before = new_folder(self.spark, "round"), self.last
        df.write.parquet(path)
        self.last = path
        if before:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return self.spark.read.schema(df.schema).parquet(path)

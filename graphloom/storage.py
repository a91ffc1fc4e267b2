"""The shared folder: where driver and executors both read and write, and lineage cuts through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as a shuffle has: a table of small rows is one partition, whatever work in Python each row makes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_counting(df: DataFrame, name: str, test: Column) -> tuple[DataFrame, int]:
    """cut(), and how many of the rows written pass the test: counted in passing, without a job of its own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(test).alias("n")), name)
    return out, seen.get["n"]


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that cut() gave, once nothing reads them any more."""
    for df in frames:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

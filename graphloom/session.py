"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.functions.registry import register_functions
from graphloom.sources.tree_source import register_source


def session(name: str = "graphloom", **conf: str) -> SparkSession:
    """Adaptive plans with skew joins, UTC; anything given goes on top. A cluster also needs spark.checkpoint.dir, a folder that all executors share."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    register_functions(spark)
    register_source(spark)
    return spark

"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one only under a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = spark._memlake_scratch = getattr(spark, "_memlake_scratch", None) or tempfile.mkdtemp(prefix="memlake-")
    return named.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path of its own."""
    return f"{folder(spark)}/memlake/{name}-{uuid.uuid4().hex}"


def held(rows: DataFrame, name: str) -> DataFrame:
    """rows written as Parquet and read back: what reads it several times sees the same rows, and lost executors cost no recomputation."""
    at = place(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)

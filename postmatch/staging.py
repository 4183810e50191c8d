"""Intermediate tables in the shared folder the cluster names.

A staged table survives the loss of executors: its readers start from files instead of lineage.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the session's warehouse.

    The default warehouse is a folder of the driver's machine, which other machines do not see: a cluster has to name one of the two.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    named = spark.sparkContext.getConf().get("spark.sql.warehouse.dir", None) is not None
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir or spark.sql.warehouse.dir to a folder that all machines share")
    return f"{warehouse}/_stage"


class Stager:
    """Writes DataFrames under one run folder and hands back readers of the files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame, name: str) -> DataFrame:
    """Stand-in for :class:`Stager` that keeps one lazy plan."""
    return df

"""Tables written between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master, as in tests, gets one made where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veldspar-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, stem: str) -> str:
    return f"{folder(spark)}/{stem.replace('*', uuid.uuid4().hex)}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: a lost executor costs no more than one step, later reads take only their columns, and
    the size is the true one, where the estimate of a checkpoint() inside a loop of joins squares with every round."""
    path = new_path(df.sparkSession, "table-*")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

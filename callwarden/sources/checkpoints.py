"""Cutting lineage between rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` or the context names, shared by driver and executors.

    Without one, a local session gets a temporary folder; a cluster has to name a shared one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="callwarden-checkpoints-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame once under the shared folder and read on from the files.

    Written files survive lost executors, and unlike an eager checkpoint the frame is computed
    only once.  Runs an action.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/callwarden-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

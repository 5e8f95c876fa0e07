"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset and all runs on this machine (tests, a laptop), a folder of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
            folder = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the table read back, and its path.

    Later reads do not depend on any executor that took part in making it. Results that are read late may depend on the table, so
    it is deleted when the driver's JVM ends, if ``remove`` has not been called before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("error").parquet(path)
    where, fs = _located(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def _located(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems; a missing path is fine."""
    where, fs = _located(spark, path)
    fs.delete(where, True)
    fs.cancelDeleteOnExit(where)

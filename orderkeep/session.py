"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds the package; workers need it on their path.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that share this folder (elsewhere: install it or use --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it; where it is unset, in local mode, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="orderkeep-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
        _until_exit(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return named


def _until_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder that exists when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one for what a query writes on its way; it goes when the driver ends, if not before."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    _until_exit(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; the rows are computed once and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: like cut(), but columns can be read one by one."""
    spark = df.sparkSession
    path = f"{own_folder(spark, 'stored')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

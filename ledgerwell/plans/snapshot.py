"""Write an intermediate table once and read it back.

A written table cuts lineage, survives the loss of executors, and carries its size,
so Spark's own broadcast threshold can decide about later joins from a measured size
instead of a hint.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a local one only for a local master."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="ledgerwell-")
    spark.conf.set(SETTING, path)
    return path


def application_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder; it goes when the application ends."""
    base = f"{shared_folder(spark)}/ledgerwell/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return base


def snapshot(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

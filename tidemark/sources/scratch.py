"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without that setting, a folder of this machine that goes with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written once to the shared folder and read back: later readers survive lost executors and recompute nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs: it does so once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

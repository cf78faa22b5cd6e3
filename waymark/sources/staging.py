"""Intermediate tables of one resolution, written where the whole cluster can read them.

A written table keeps plans short, is read again rather than computed again when an executor is lost, and gives
the optimiser its true size.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without one, a temporary folder of this process in local mode only."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="waymark-staging-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # when the driver ends
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

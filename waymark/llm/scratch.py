"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts lineage: if an executor is lost later, its rows are read again from the
shared store instead of being computed again, and row order and partition numbers that were
stored with the rows stay what they were.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_released: dict[str, list[str]] = {}
_local_root: str | None = None
_small_reads = threading.Lock()
#: Rows of a batch, bytes of a buffer, and rows that go to Python at once, when tables are read sparingly.
SMALL_READS = {"spark.sql.parquet.columnarReaderBatchSize": 256, "parquet.read.allocation.size": 1 << 18, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this process only in local mode without one."""
    global _local_root
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def table(df: DataFrame, name: str, scope: str = "") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    ``scope`` groups tables that :func:`release` may delete together.
    """
    spark = df.sparkSession
    path = new_path(spark, name, scope)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """What runs in this block reads Parquet, and hands it to Python, in small batches; afterwards the settings are as before.

    Batches of long texts are arrays of many MB. A stage that only reads and filters makes them faster than they are
    collected, and the heap grows for them and never shrinks. Rows are the same; other queries of the session that
    begin meanwhile read so as well.
    """
    with _small_reads:
        before = {name: spark.conf.get(name, None) for name in SMALL_READS}
        try:
            _read_small(spark)
            yield
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _read_small(spark: SparkSession) -> None:
    for name, most in SMALL_READS.items():
        if not 0 < int(spark.conf.get(name, None) or 0) < most:
            spark.conf.set(name, most)


def keep_small_reads(spark: SparkSession) -> None:
    """The session reads as in :func:`small_reads` from now on: for jobs whose last frames run after they return. A smaller setting stays."""
    with _small_reads:  # a block that is about to end would put back what was before it
        _read_small(spark)


def new_path(spark: SparkSession, name: str, scope: str = "") -> str:
    """A new place in the shared folder, deleted by :func:`release` or else when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _released.setdefault(scope, []).append(path)
    store, where = _stored(spark, path)
    store.deleteOnExit(where)
    return path


def _stored(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def release(spark: SparkSession, scope: str) -> None:
    """Delete the tables written under ``scope``; frames that read them must be finished with."""
    for path in _released.pop(scope, []):
        store, where = _stored(spark, path)
        store.delete(where, True)


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row per key of ``groups``, whose ``count`` says how many rows each key has.

    Keys with more than one in ``share`` of all rows, fewer than ``share`` of them, are broadcast;
    the rest is shuffled, and no key of it is large.
    """
    hot, other = split_hot(groups, count, share)
    rest = rows.join(broadcast(hot.select(*keys)), keys, "left_anti").join(other, keys)
    return rows.join(broadcast(hot), keys).unionByName(rest)


def without_hot(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, share: int = 1000) -> DataFrame:
    """The rows whose key is not in ``groups``, by the same two ways."""
    hot, other = split_hot(groups, count, share)
    return rows.join(broadcast(hot.select(*keys)), keys, "left_anti").join(other.select(*keys), keys, "left_anti")


def split_hot(groups: DataFrame, count: str, share: int) -> tuple[DataFrame, DataFrame]:
    """The groups with more than one in ``share`` of all rows, fewer than ``share`` of them, and the others."""
    total = groups.agg({count: "sum"}).first()[0] or 0
    least = max(1000, total // share)
    return groups.filter(groups[count] > least), groups.filter(groups[count] <= least)

"""Change files as a stream: each arrival is folded and applied to the staged table, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import applied, fold_versions
from ..sources.store import table_or_empty


def apply_deltas(spark: SparkSession, source: str, schema: str, staged: str, checkpoint: str, key: str, columns: list[str], now: Column) -> StreamingQuery:
    """Read what is new in ``source`` (Parquet), fold it, and write the next version of the table under ``staged``.

    Versions are numbered by batch, so a batch that runs again after a failure writes the same
    version from the same one before it. The checkpoint is the cursor. A table that was staged before the first batch
    is its baseline, under ``version=-1``.
    """

    def take(batch: DataFrame, number: int) -> None:
        folded = fold_versions(batch, key, now)
        before = table_or_empty(batch.sparkSession, f"{staged}/version={number - 1}", batch.select(key, *columns).schema)
        after = applied(before.select(key, *columns), folded, key)
        after.write.mode("overwrite").parquet(f"{staged}/version={number}")

    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The file watcher as a stream: debounced events become upserts, and a cache with a time to live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def debounced(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last event per key of a micro-batch, which is how repeated events on one path become one."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return batch.withColumn("r_", r).where("r_ = 1").drop("r_")


def upsert_stream(events: DataFrame, store, checkpoint: str, key: str = "chunk_id", order: str = "stored_at", interval: str | None = None, then: Callable | None = None):
    """Starts the query that upserts (key, vector, order) into a ``sources.store.Store``, batch by batch.

    A batch that is run again after a failure writes the same rows, since an upsert is idempotent.
    Without an interval all that is available is taken and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(batch.sparkSession, debounced(batch, key, order), order)
        if then:
            then(batch, number)

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def fresh(queries: DataFrame, time: str = "cached_at", key: tuple = ("query", "model"), ttl: str = "1 hour") -> DataFrame:
    """A stream of cache entries without repeats of a key within the time to live; state older than it is dropped."""
    return queries.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl).dropDuplicatesWithinWatermark(list(key))

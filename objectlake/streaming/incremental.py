"""Streaming forms: the tombstone index and request metrics over a growing log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.edits import OBJECT
from .index import KeyedIndex

TOMBSTONES = "object_type string, object_id string, created_at timestamp, id long, operation string"
WINDOWS = "start timestamp, route string, batch long, n long, errors long, error_ratio double"


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tombstone_index(spark: SparkSession, root: str, buckets: int = 64) -> KeyedIndex:
    """Each object's last applied operation. Only buckets of objects that a batch names are rewritten."""
    return KeyedIndex(spark, root, TOMBSTONES, tuple(OBJECT), ("created_at", "id"), buckets)


def index_applied(log: DataFrame, index: KeyedIndex, checkpoint: str) -> StreamingQuery:
    """Merge what a growing log has applied into the index, all that is there now."""
    applied = log.filter("status = 'applied'").select(*OBJECT, "created_at", "id", "operation")
    return run_to_end(applied, checkpoint, lambda rows, batch: index.merge(rows, batch), "append")


def red_index(spark: SparkSession, root: str, buckets: int = 16) -> KeyedIndex:
    """The last figures of every window and route."""
    return KeyedIndex(spark, root, WINDOWS, ("start", "route"), ("batch",), buckets)


def red_stream(requests: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """n, errors and error_ratio by window and route; requests: at (timestamp), route, status.

    For update mode: a batch gives the windows that it changes, and state of windows older than late is
    dropped, as are requests that come later than that.
    """
    return (
        requests.withWatermark("at", late).groupBy(F.window("at", every), "route")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("errors"))
        .select(F.col("window.start").alias("start"), "route", "n", "errors", (F.col("errors") / F.col("n")).alias("error_ratio"))
    )


def index_red(requests: DataFrame, index: KeyedIndex, checkpoint: str, every: str = "1 day", late: str = "2 days") -> StreamingQuery:
    """Merge the windows that each batch changes into the index, all that is there now."""
    return run_to_end(red_stream(requests, every, late), checkpoint, lambda rows, batch: index.merge(rows.withColumn("batch", F.lit(batch).cast("long")), batch))


def run_to_end(out: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], object], mode: str = "update") -> StreamingQuery:
    """All that is there now, batch by batch, into a sink; a restart goes on from the checkpoint."""
    query = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query

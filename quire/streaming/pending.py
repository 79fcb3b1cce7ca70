"""An extension: pending chunks as a stream, upserted into a finished table batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``work`` over new PENDING chunks of a folder and append the finished ones, once for each batch.

    A batch's files carry its number: a batch that is run again after a failure overwrites its own.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df.filter("status = 'PENDING'")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Streaming ingest: files of changes become runs, one for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, schema, source: str, target: str, checkpoint: str, to_log: Callable[[DataFrame], DataFrame], pattern: str = "*.parquet") -> DataFrame:
    """Read what is new in ``source``, append it to the runs in ``target`` and return all runs as a change log.

    Late changes need no watermark: a lower sequence number loses against a newer version. A micro-batch that is
    replayed after a failure overwrites its own run.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        to_log(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).drop("batch")

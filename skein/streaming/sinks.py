"""A log written by a stream, every row exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def append_stream(events: DataFrame, table: str, checkpoint: str, day: str = "occurred_on", available: bool = True) -> StreamingQuery:
    """Start an append of a streaming frame to a log partitioned by day.

    The sink's own log names the files of each finished batch. A batch that was killed is written again under the same number
    from the offsets in ``checkpoint``, and files it left behind are in no log, so readers never see a row twice. Table and checkpoint
    must lie on shared storage, and one query at a time may write a table. ``available`` ends the query when all
    present rows are written; otherwise it runs on.
    """
    writer = events.writeStream.format("parquet").outputMode("append").partitionBy(day).option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()


def read_log(spark: SparkSession, table: str, schema) -> DataFrame:
    """Rows of the finished batches of such a log."""
    return spark.read.schema(schema).parquet(table)

"""Late rows, told apart before any aggregate.

Spark drops what comes after the watermark inside its state operators and tells groups, not rows. Here every micro-batch is cut in two before that: rows whose
window the watermark had passed when the batch began go to a side table, the others to the data; ``observe`` counts both in the pass that writes them. The watermark is that of Spark: the largest event
time of all batches before, less the delay; it is written with each batch, so a restart or a repeated batch sees the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def split_late(stream: DataFrame, folder: str, time: str, delay_seconds: int, window_seconds: int):
    """Run a stream over all available data; ``folder/split`` gets its rows by batch and by whether they are late.

    A row is late if its window of ``window_seconds`` (aligned to the epoch) ended at the watermark or before. Rows without a time are never late. Figures
    of each batch (largest time in ms, rows, late rows) are in ``folder/marks``. A batch that runs again overwrites its own folders.
    """
    spark = stream.sparkSession
    shape = "top long, rows long, late long"

    def write(batch: DataFrame, number: int) -> None:
        top = None
        if number:
            before = spark.read.schema(f"{shape}, batch long").parquet(f"{folder}/marks").where(F.col("batch") < number)
            top = before.agg(F.max("top")).first()[0]
        ends = (F.floor(F.unix_micros(time) / (window_seconds * 1_000_000)) + 1) * window_seconds * 1000
        is_late = F.coalesce(ends <= F.lit(top - delay_seconds * 1000), F.lit(False)) if top is not None else F.lit(False)
        seen = Observation()
        marked = batch.withColumn("__late", is_late).observe(
            seen, F.max(F.unix_millis(time)).alias("top"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__late")).alias("late"))
        marked.write.mode("overwrite").partitionBy("__late").parquet(f"{folder}/split/batch={number}")  # one pass: both sides and the figures
        figures = seen.get
        spark.createDataFrame([(figures["top"], figures["rows"], figures["late"])], shape).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def rows_of(spark, folder: str, schema, late: bool) -> DataFrame:
    """The rows that were in time, or late."""
    found = spark.read.schema(schema).option("basePath", f"{folder}/split").parquet(f"{folder}/split")
    return found.where(F.col("__late") == late).select(*schema.names)


def marks(spark, folder: str) -> DataFrame:
    """batch, top, rows, late of every batch."""
    return spark.read.schema("top long, rows long, late long, batch long").parquet(f"{folder}/marks")

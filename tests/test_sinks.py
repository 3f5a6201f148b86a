"""The streaming log: exactly once over killed batches and leftover files."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.streaming.sinks import append_stream, read_log

SCHEMA = "id long, body string, occurred_on string"


def run(spark, source, table, checkpoint, broken):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    # A row of the second file fails while the batch is being written.
    bad = F.when(F.lit(broken) & (F.col("id") == 15), F.raise_error(F.lit("lost executor")).cast("string")).otherwise(F.col("body"))
    query = append_stream(stream.withColumn("body", bad), table, checkpoint)
    query.awaitTermination()


def test_killed_batch_is_written_once(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "log", "state"))
    for n in range(3):
        # Repeated rows are rows: both copies of id 10 * n stay. Days may be null.
        rows = [(10 * n + i, f"b{i}", f"2024-01-0{1 + i % 3}" if i % 4 else None) for i in range(10)] + [(10 * n, "b0", None)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        os.utime(max((os.path.join(source, f) for f in os.listdir(source) if f.endswith(".parquet")), key=os.path.getmtime), (1_700_000_000 + n,) * 2)
    want = Counter(tuple(r) for r in spark.read.schema(SCHEMA).parquet(source).collect())
    with pytest.raises(Exception, match="lost executor"):
        run(spark, source, table, checkpoint, True)
    first = read_log(spark, table, SCHEMA).count()
    assert first < sum(want.values())
    # What a killed task may leave: a file that no batch names.
    spark.createDataFrame([(777, "left", "2024-01-01")], SCHEMA).write.mode("append").partitionBy("occurred_on").parquet(table + "-left")
    left = [os.path.join(d, f) for d, _, fs in os.walk(table + "-left") for f in fs if f.endswith(".parquet")]
    day = os.path.join(table, "occurred_on=2024-01-01")
    os.makedirs(day, exist_ok=True)
    with open(left[0], "rb") as src, open(os.path.join(day, "part-left.parquet"), "wb") as dst:
        dst.write(src.read())
    run(spark, source, table, checkpoint, False)
    run(spark, source, table, checkpoint, False)
    assert Counter(tuple(r) for r in read_log(spark, table, SCHEMA).select("id", "body", "occurred_on").collect()) == want


def test_empty_source(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    run(spark, source, table, str(tmp_path / "state"), False)
    assert read_log(spark, table, SCHEMA).count() == 0

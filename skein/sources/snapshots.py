"""Stored tables: results written once, versioned snapshots and append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.session import work_folder

POINTER = "CURRENT"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str, tidy: bool = False) -> DataFrame:
    """Write a result below the shared work folder and read it back, which cuts its lineage.

    ``tidy``: the shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path, before = work_folder(spark, purpose), spark.conf.get(CLEANUP)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _filesystem(spark, path)
    return fs.getFileStatus(hadoop.Path(path)).isDirectory()


def content_version(df: DataFrame) -> tuple:
    """Names, sizes and times of the files of a scan: changes when they do, and reads none of them."""
    spark = df.sparkSession
    out = []
    for name in sorted(df.inputFiles()):
        fs, hadoop = _filesystem(spark, name)
        status = fs.getFileStatus(hadoop.Path(spark._jvm.java.net.URI(name)))
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def current_version(spark: SparkSession, table: str) -> str | None:
    """Name of the version the pointer names, None for a table without one."""
    fs, hadoop = _filesystem(spark, table)
    pointer = hadoop.Path(table, POINTER)
    if not fs.exists(pointer):
        return None
    return spark.read.text(str(pointer)).first()["value"]


def read_snapshot(spark: SparkSession, table: str, schema) -> DataFrame:
    """Current snapshot; an empty frame for a table without one."""
    version = current_version(spark, table)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{table}/{version}")


def write_snapshot(df: DataFrame, table: str) -> str:
    """Write a full new version, then move the pointer to it.

    A failed write leaves the pointer, and so every reader, on the version before.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{version}")
    fs, hadoop = _filesystem(spark, table)
    fresh = hadoop.Path(table, f".{POINTER}-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(fresh, hadoop.Path(table, POINTER), options)
    return version


def append_events(events: DataFrame, table: str, day: str = "occurred_on") -> None:
    """Append rows to a log partitioned by day; nothing is ever rewritten."""
    events.write.mode("append").partitionBy(day).parquet(table)

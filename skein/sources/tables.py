"""Parquet tables and their partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with at least one partition per core.

    Work that is heavy per row (regular expressions over long texts) would else run in
    one task if the table is one small file. A scan that already has enough splits, as
    every large table does, is left as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)

"""What the operators of this subpackage share: stored tables, worker paths, buckets of ids."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import prepare, work_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bounds per step of the search for a value's bucket.
FAN = 100
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, and this checkout on the path of Python workers (a cluster ships the package instead).

    Batches of texts are held twice on their way to a worker, so they have fewer rows than usual.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return prepare(spark)


def release() -> None:
    """Gives the memory that a Python worker no longer uses back to the system; the worker itself stays for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over the batches of a task, with ``release`` after its last batch."""

    def ended(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return ended


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written below ``spark.checkpoint.dir`` and read again: a table that outlives lost executors.

    The shuffle files of the write are of no use afterwards, so they go with it.
    """
    spark = df.sparkSession
    folder, before = work_folder(spark, purpose), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, mod n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row."""
    return F.transform(F.array(value), use)[0]


def id_bounds(df: DataFrame, column: str, rows: int, most: int) -> list:
    """Rising values of a numeric column that cut the rows in buckets of about ``rows``, ``most`` at the most; the last is the largest value.

    Only where rows are dealt to depends on the bounds. They are a bounded list of
    percentiles, found in one pass over the column.
    """
    n = df.count()
    buckets = max(1, min(most, -(-n // rows)))
    shares = [(i + 1) / buckets for i in range(buckets)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * buckets)).alias("cuts"), F.max(column).alias("top")).first()
    return sorted({*found["cuts"], found["top"]}) if found["top"] is not None else []


def bucket_of(value: Column, bounds: list) -> tuple[Column, Column]:
    """The place of the first bound not below the value (null: 0), and whether the value is that bound.

    Found in two steps, so that the work per row stays small for thousands of bounds.
    """
    if not bounds:
        return F.lit(0), F.lit(False)
    heads = F.array(*[F.lit(bounds[i]) for i in range(0, len(bounds), FAN)])
    parts = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + FAN]]) for i in range(0, len(bounds), FAN)])
    group = F.greatest(F.size(F.filter(heads, lambda b: b < value)) - 1, F.lit(0))
    place = let(group, lambda g: let(F.get(parts, g), lambda own: g * FAN + F.size(F.filter(own, lambda b: b < value))))
    exact = let(group, lambda g: F.array_contains(F.get(parts, g), value)) | F.array_contains(heads, value)
    return F.when(value.isNull(), F.lit(0)).otherwise(place).cast("int"), F.coalesce(exact, F.lit(False))

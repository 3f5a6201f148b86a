"""Joins, row numbers and neighbours that hold when one key owns a large share of the rows.

Every key is treated in the same way, in two levels: rows meet inside (key, part) or (key,
bucket), and what the parts of a key need of each other is a small table of their counts or
ends. There is no list of hot keys and no row count from which anything changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def spread_join(facts: DataFrame, dims: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join facts to a side with few rows per key; the facts of a key are dealt to up to ``salts`` parts.

    ``how`` is inner, left, left_semi or left_anti. A dims row is repeated for the parts its key has
    among the facts, so never more often than the key has facts.
    """
    on = list(on)
    rest = [c for c in facts.columns if c not in on]
    row_hash = F.xxhash64(*[F.col(c) for c in rest]) if rest else F.lit(0).cast("long")
    left = facts.withColumn("__part", F.pmod(row_hash, F.lit(salts).cast("long")))
    right = dims.join(left.select(*on, "__part").distinct(), on)
    return left.join(right, [*on, "__part"], how).drop("__part")


def _same_bucket(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the keys and the bucket, where null is a bucket as well."""
    other = ends.select(*[F.col(c).alias(f"__k_{c}" if c in keys else c) for c in ends.columns if c != "__bucket"],
                        F.col("__bucket").alias("__b"))
    condition = F.col("__bucket").eqNullSafe(F.col("__b"))
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"__k_{key}"))
    return rows.join(other, condition, "left").drop("__b", *[f"__k_{key}" for key in keys])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str, descending: bool = False) -> DataFrame:
    """Row number per key, found bucket by bucket.

    ``bucket`` must rise with the order (a truncated timestamp, say; a struct of such
    columns if one is too coarse). A row's number is its place in the bucket plus the
    rows in earlier buckets, so no task holds a whole key. Keys must not be null.
    """
    keys = list(keys)
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    step = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    earlier = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__bucket", F.sum("__n").over(earlier).alias("__before"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    placed = _same_bucket(rows.withColumn("__inside", F.row_number().over(inside)), offsets, keys)
    return placed.withColumn(name, (F.col("__inside") + F.coalesce("__before", F.lit(0))).cast("long")).drop(
        "__bucket", "__inside", "__before"
    )


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Values of the row before, per key, found bucket by bucket.

    The first row of a bucket takes the last row of the nearest earlier bucket.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("__bucket", bucket)
    value = F.struct(*columns)
    last = rows.groupBy(*keys, "__bucket").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    across = Window.partitionBy(*keys).orderBy("__bucket")
    ends = last.select(*keys, "__bucket", F.lag("__end").over(across).alias("__carry"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    out = _same_bucket(rows.withColumn("__lag", F.lag(value).over(inside)), ends, keys)
    found = F.coalesce(F.col("__lag"), F.col("__carry"))
    for name in columns:
        out = out.withColumn(prefix + name, found.getField(name))
    return out.drop("__bucket", "__lag", "__carry")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key. Spark limits each group before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("long"))


def most_common(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """K2: the n most frequent values, by value on ties."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column).limit(n)


def most_common_approximately(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """K2 for very many values: a sketch of fixed size per task instead of a shuffle of all values."""
    found = df.agg(F.expr(f"approx_top_k({column}, {int(n)})").alias("top")).select(F.explode("top").alias("t"))
    return found.select(F.col("t.item").alias(column), F.col("t.count").alias("rows"))

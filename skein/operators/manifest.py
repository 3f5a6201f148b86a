"""An order-fixed manifest of a corpus as a hash tree, and the rows in which two corpora differ.

A leaf is the SHA-256 of a row and how often the row occurs. Leaves lie in buckets by the first hex digits of their digest, so
buckets are even whatever the keys are, and the tree depends on the rows alone, not on partitions or file order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.snapshots import stored

#: Hex digits of a bucket; 4 are 65,536 buckets. One more digit for each factor of 16 in rows keeps buckets as small.
DEPTH = 4


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the values as text, each behind its length, so that no two rows read alike; null is a sign of its own."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _above(children: DataFrame, depth: int) -> DataFrame:
    """Nodes of a depth from the at most 16 children of each."""
    listed = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
    return children.groupBy(F.substring("prefix", 1, depth).alias("prefix")).agg(listed.alias("c"), F.sum("rows").alias("rows")).select(
        F.lit(depth).alias("depth"), "prefix", F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["prefix"], F.lit("="), x["digest"])), ","), 256).alias("digest"), "rows")


def manifest(rows: DataFrame, columns: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """depth, prefix, digest, rows of every node; the root has depth 0 and an empty prefix.

    Equal rows are counted before they meet in a bucket. An empty table has no nodes. Keep the nodes with a snapshot: two
    snapshots are equal if their roots are, and ``changed_buckets`` finds where they differ from the nodes alone.
    """
    leaves = rows.select(row_digest(columns).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    told = F.concat("leaf", F.lit("*"), F.col("n").cast("string"))
    buckets = leaves.groupBy(F.substring("leaf", 1, depth).alias("prefix")).agg(F.array_sort(F.collect_list(told)).alias("c"), F.sum("n").alias("rows"))
    levels = [buckets.select(F.lit(depth).alias("depth"), "prefix", F.sha2(F.array_join("c", ","), 256).alias("digest"), "rows")]
    for above in range(depth - 1, -1, -1):
        levels.append(_above(levels[-1], above))
    return reduce(DataFrame.unionByName, levels)


def changed_buckets(before: DataFrame, after: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Prefixes of the buckets that differ, found downwards: only children of nodes that differ are compared.

    ``before`` and ``after`` are stored manifests of one depth, as every level reads them; each level is written before the next.
    """
    open_ = None
    for level in range(depth + 1):
        a = before.where(F.col("depth") == level).select("prefix", F.col("digest").alias("old"))
        b = after.where(F.col("depth") == level).select("prefix", F.col("digest").alias("new"))
        if open_ is not None:
            up = F.substring("prefix", 1, level - 1) == F.col("parent")
            a, b = a.join(open_, up, "left_semi"), b.join(open_, up, "left_semi")
        differ = a.join(b, "prefix", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
        open_ = stored(differ.select(F.col("prefix").alias("parent")), "manifest-changes")
    return open_.withColumnRenamed("parent", "prefix")


def changed_rows(before: DataFrame, after: DataFrame, columns: Sequence[str], buckets: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows of changed buckets that one side has more often: the columns, ``n_before`` and ``n_after``.

    Rows of equal buckets are left where they are; they cost a digest each, no shuffle.
    """
    bucket = F.substring(row_digest(columns), 1, depth)

    def counted(rows: DataFrame, side: str) -> DataFrame:
        few = rows.select(*columns, bucket.alias("prefix")).join(buckets, "prefix", "left_semi").drop("prefix")
        return few.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))

    both = counted(before, "before").unionByName(counted(after, "after")).groupBy(*columns).agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in ("before", "after")])
    return both.where("n_before <> n_after")

"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words. DataFrame functions only.

Every source gets a target by weight; a target stops at ``most`` times the source's size, and
the excess goes to the others by weight. The corpus is cut in blocks of ``block_words`` words.
Highest quotients (target / 1, 3, 5, ...) give every source its number of blocks, and the same
rule shares a source's blocks among its shards, by size. Inside a shard the documents lie in
a seeded order on one line of words; the shard's blocks are taken in a row from a seeded block
on, going round, so at most the documents at the ends are taken in part.

Shards are cut by a hash of the document id, so no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"


def apportion(df: DataFrame, by: list[str], names: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """``seats`` of each group shared among its rows by the highest quotients weight / (2 j + 1).

    With n rows in a group the result differs from the exact share q by at most
    q n / (2 seats) + 1/2, so only the quotients in that range are made and ranked:
    about four per row, however many seats there are. Ties go to the larger weight, then by name.
    """
    group = Window.partitionBy(*by)
    total, n = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    real = (F.col(weight) > 0) & (F.col(seats) > 0)
    share = F.col(weight) * F.col(seats) / total
    slack = share * n / (2 * F.col(seats)) + 1.5
    rows = df.withColumns({
        "__base": F.when(real, F.greatest(F.lit(0).cast("long"), F.floor(share - slack))).otherwise(F.lit(0).cast("long")),
        "__tries": F.when(real, F.ceil(2 * slack) + 2).otherwise(F.lit(0).cast("long")),
    }).withColumn("__need", F.col(seats) - F.sum("__base").over(group))
    tries = rows.select(
        *by, *[c for c in names if c not in by], weight, "__need",
        F.explode(F.when(F.col("__tries") > 0, F.sequence(F.col("__base"), F.col("__base") + F.col("__tries") - 1))).alias("__j"),
    ).withColumn("__quotient", F.col(weight) / (2 * F.col("__j") + 1))
    order = Window.partitionBy(*by).orderBy(F.desc("__quotient"), F.desc(weight), *names, "__j")
    won = (
        tries.withColumn("__place", F.row_number().over(order))
        .where(F.col("__place") <= F.col("__need"))
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("__won"))
    )
    return rows.join(won, names, "left").withColumn(out, F.col("__base") + F.coalesce("__won", F.lit(0))).drop(
        "__base", "__tries", "__need", "__won"
    )


def _number(text: Column) -> Column:
    """The first 32 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source (``source_key``, ``source_size``) with ``target``.

    The final level is where all that exceeds a limit has been reshared: with sources in the
    order of limit / weight, the first whose limit lies above the level of the rest. There are
    few sources, so they meet in one window.
    """
    every = Window.partitionBy(F.lit(1))
    place = F.row_number().over(every.orderBy("source_key"))
    rows = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    ).withColumn("limit", F.col("source_size") * most)
    order = every.orderBy(F.col("limit") / F.col("weight"), "source_key")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * share - before) / rest)
    final = F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(every)
    return rows.withColumn("target", F.least(F.col("limit"), F.coalesce(final["level"], F.lit(0.0)) * F.col("weight"))).drop("weight", "limit", "level")


def mixed(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 8,
    shard_words: int = 1_000_000,
    seed: str = "mix-1",
) -> DataFrame:
    """doc_id, tie (a hash of the text), source, size, source_size, target, taken for every row of ``docs``.

    A null text has no words, a null source is a source of its own, last in order. Rows without words
    take nothing. Equal rows count each; a null id is an id. Reruns give the same rows.
    An empty table gives none. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("source_key", key).withColumn("__order", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))),
        "mix-sizes",
    )
    sources = targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, most)
    every = Window.partitionBy(F.lit(1))
    sources = sources.withColumn("__seats", F.round(F.sum("target").over(every) / block_words).cast("long")).withColumn("__all", F.lit(1))
    sources = stored(apportion(sources, ["__all"], ["source_key"], "target", "__seats", "blocks"), "mix-sources")
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words))
    cut = sources.select("source_key", "source_size", "target", "blocks", shards.alias("__shards"))
    placed = rows.join(cut.select("source_key", "__shards"), "source_key").withColumn("shard", F.pmod(
        F.conv(F.substring("__order", 9, 8), 16, 10).cast("long"), F.col("__shards")
    )).drop("__shards")
    sizes = placed.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size")).join(cut, "source_key")
    quotas = apportion(sizes, ["source_key"], ["source_key", "shard"], "shard_size", "blocks", "quota")
    length = F.ceil(F.col("shard_size") / block_words)
    start = F.pmod(_number(F.concat_ws(":", F.lit(seed), "source_key", F.col("shard").cast("string"))), F.greatest(length, F.lit(1)))
    quota = F.least(F.col("quota"), F.floor(length * most))
    quotas = quotas.select(
        F.col("source_key").alias("__key"), F.col("shard").alias("__shard"), "source_size", "target", length.alias("__length"), start.alias("__start"),
        F.when(length > 0, F.floor(quota / length)).otherwise(F.lit(0)).alias("__laps"),
        F.when(length > 0, F.pmod(quota, length)).otherwise(F.lit(0)).alias("__rest"),
    )
    line = Window.partitionBy("source_key", "shard").orderBy("__order", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__first")
    last = first + F.col("size")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(last, high * block_words) - F.greatest(first, low * block_words))

    end = F.col("__start") + F.col("__rest")
    taken = F.col("__laps") * F.col("size") + overlap(F.col("__start"), F.least(end, F.col("__length"))) + overlap(F.lit(0).cast("long"), end - F.col("__length"))
    return (
        placed.withColumn("__first", F.coalesce(F.sum("size").over(line), F.lit(0).cast("long")))
        .join(quotas, (F.col("source_key") == F.col("__key")) & (F.col("shard") == F.col("__shard")))
        .select("doc_id", "tie", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``, by ``mixed``."""
    return mixed(docs, **options).drop("tie")


def repeated(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: words taken over words held, rounded, so 0 to 2 times.

    Rows that share id and text are one document here, and what they take adds up. Documents without words go.
    """
    shares = mixed(docs, text, source, doc_id, **options).groupBy("doc_id", "tie").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    shares = shares.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), times.alias("__times")).where("__times > 0")
    rows = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(shares, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tie"))).dropDuplicates([doc_id, "__own"])
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)

"""Document fingerprints by closed syncmers. DataFrame functions only.

A text is a sequence of tokens: its words, those over 16 characters cut in pieces of 16. A run of
five tokens (k) is chosen as an anchor if, of its inner runs of two (s), the first or the last has the smallest
hash. Whether a run is an anchor depends on its own tokens alone, so equal passages have
equal anchors wherever they stand, and at most three runs in a row (k - s) have none chosen.

A fingerprint lists the anchors in text order, nine hex digits each: the distance to the anchor
before (the first: to the start) and 32 bits of the run's hash. So positions can be read back
and matched, and likeness is the share of common anchors in all distinct ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import bucket_of, id_bounds, let

TOKEN = r"[^\x20\x09-\x0D]{1,16}"
K, S = 5, 2
#: Runs of s tokens in a run of k.
INNER = K - S + 1


def anchors(text: Column) -> Column:
    """array<struct<gap int, mark string>> of a text; null counts as empty.

    A text with fewer than k tokens has one anchor, all its tokens; one without tokens has none.
    """

    def chosen(marks: Column) -> Column:
        inner = F.zip_with(marks, F.slice(marks, S, F.size(marks)), lambda x, y: F.xxhash64(x, y))

        def edges(h: Column) -> Column:
            def low(i: Column) -> Column:
                return F.least(*[F.get(h, i + j) for j in range(INNER)])

            runs = F.sequence(F.lit(0), F.size(marks) - K)
            return F.filter(runs, lambda i: F.least(F.get(h, i), F.get(h, i + (INNER - 1))) == low(i))

        return let(inner, edges)

    def short(mark: Column) -> Column:
        return F.right(F.lpad(F.hex(mark), 16, "0"), F.lit(8))

    def listed(marks: Column) -> Column:
        n = F.size(marks)
        long = let(chosen(marks), lambda at: F.transform(at, lambda i, j: F.struct(
            F.when(j > 0, i - F.get(at, j - 1)).otherwise(i).alias("gap"),
            short(F.xxhash64(*[F.get(marks, i + m) for m in range(K)])).alias("mark"),
        )))
        few = F.array(F.struct(F.lit(0).alias("gap"), short(F.xxhash64(F.concat_ws(",", F.transform(marks, lambda x: x.cast("string"))))).alias("mark")))
        return F.when(n >= K, long).when(n > 0, few).otherwise(F.slice(few, 1, 0))

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), listed)


def fingerprint(found: Column) -> Column:
    """The anchors as one string of hex digits."""
    return F.array_join(F.transform(found, lambda a: F.concat(F.lower(F.hex(a["gap"])), F.lower(a["mark"]))), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct marks over all distinct marks; 1 if both texts have none, 0 if one has."""
    one, other = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(one, other))
    either = F.size(one) + F.size(other) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def positions(marks: DataFrame, column: str = "fingerprint") -> DataFrame:
    """One row per anchor of each fingerprint: the frame's columns, ``position`` (in tokens) and ``mark``."""
    units = F.regexp_extract_all(F.col(column), F.lit("(.{9})"), 1)
    gaps = F.transform(units, lambda u: F.conv(F.left(u, F.lit(1)), 16, 10).cast("int"))
    with_gaps = marks.withColumn("__gaps", gaps).select(*marks.columns, "__gaps", F.posexplode(units).alias("__i", "__unit"))
    place = F.aggregate(F.slice("__gaps", F.lit(1), F.col("__i") + 1), F.lit(0), lambda a, g: a + g)
    return with_gaps.select(*marks.columns, place.alias("position"), F.right("__unit", F.lit(8)).alias("mark"))


def with_next(docs: DataFrame, doc_id: str, column: str, bucket_rows: int, most_buckets: int, prepare: dict[str, Column]) -> DataFrame:
    """Each row with ``column`` and the prepared columns of the next row by descending id, around the end.

    Bounds taken from the ids cut the rows in buckets of neighbours, nulls in the lowest. A bound is itself the id of a
    row, the one that follows the last of the bucket above, so those rows are sent to both buckets and
    one sort per bucket finds every neighbour. Equal ids follow in order of ``column``; null ids come last.
    """
    bounds = id_bounds(docs, doc_id, bucket_rows, most_buckets)
    bucket, last = bucket_of(F.col(doc_id), bounds)
    if not bounds:  # no ids at all: one bucket, and its first row follows its last
        last = F.lit(True)
    rows = docs.withColumn("__own", bucket)
    own = F.struct(F.col("__own").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("__own") + 1, F.lit(max(1, len(bounds)))).cast("int").alias("bucket"), F.lit(1).alias("guest"))
    rows = rows.withColumn("__to", F.explode(F.when(last, F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select(*docs.columns, F.col("__to.bucket").alias("__bucket"), F.col("__to.guest").alias("__guest"))
    order = [F.col("__bucket").asc(), F.col("__guest").asc(), F.col(doc_id).desc_nulls_last(), F.col(column).asc()]
    rows = rows.repartition("__bucket").sortWithinPartitions(*order).withColumns(prepare)
    line = Window.partitionBy("__bucket").orderBy(*order[1:])
    return rows.withColumns({f"next_{c}": F.lead(c).over(line) for c in (column, *prepare)}).where("__guest = 0").drop("__bucket", "__guest")


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_rows: int = 1000, most_buckets: int = 10_000) -> DataFrame:
    """Fingerprints of every text and of its edit: its last half (rounded down) replaced by the start of the next text.

    Next is the document with the next smaller id; after the last comes the first. Gives doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text counts as empty: no anchors, likeness 1 to another
    such text and 0 to the rest. Repeated rows and ids follow each other in order of text; null ids come last.
    A single row is its own next. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", "text", bucket_rows, most_buckets, {"anchors": anchors(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = rows.withColumn("edited", edited).withColumn("edited_anchors", anchors(F.col("edited")))
    marks = [F.col(c)["mark"] for c in ("anchors", "edited_anchors", "next_anchors")]
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(marks[0], marks[1]).alias("near_edited"), likeness(marks[0], marks[2]).alias("near_next"),
    )

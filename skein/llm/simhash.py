"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees within a Hamming radius.

Equal fingerprints are one class from the start. Two fingerprints within radius 3 agree on at
least two of five bands of bits, so the classes are dealt to shards by each pair of
bands (ten shards per class, of about 26 bits each), and links within the radius meet in some shard. Every shard
builds BK-trees over its fingerprints: children are keyed by their Hamming distance to the
parent, and a search at distance d follows the edges from d - radius to d + radius only. A shard with more than
``tree_size`` fingerprints is cut in trees of that size on average; each tree is sent to the tasks that
hold the other parts of the shard, so no task holds a whole hot shard. A task keeps a forest of
the links it finds, never all pairs; the components of all forests are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import releasing, stored
from skein.llm.components import Sets, components

BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bands that must agree. More than len(BANDS) - AGREE changed bits could break all pairs.
AGREE = 2
CHUNK = 1 << 16
ALL_BITS = (1 << 64) - 1


def simhash(text: str | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of the shingles of ``width`` words, repeats included; 0 without words.

    A-Z count as a-z; words are what ASCII white space separates. Fewer words than a shingle
    has make one shingle. A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype="i8")
    for at in range(0, len(values), CHUNK):
        ones += np.unpackbits(values[at : at + CHUNK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return mark(text)


def distance(a: int, b: int) -> int:
    """Bits that differ; numbers may be signed."""
    return ((a ^ b) & ALL_BITS).bit_count()


class Tree:
    """A BK-tree over distinct 64-bit numbers."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            far = distance(self.values[at], value)
            if far not in self.children[at]:
                self.children[at][far] = len(self.values) - 1
                return
            at = self.children[at][far]

    def near(self, value: int, radius: int) -> Iterator[int]:
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            far = distance(self.values[at], value)
            if far <= radius:
                yield self.values[at]
            todo += [child for edge, child in self.children[at].items() if far - radius <= edge <= far + radius]


def _link(values: list[int], others: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A forest of the links within ``values``, or between ``values`` and ``others``.

    A search ends early once its value is in one set with the whole tree: no link it
    could still find would join anything.
    """
    sets, tree, apart = Sets(), Tree(), 0
    for value in values:
        if others is None:
            apart += 1
            for found in tree.near(value, radius):
                apart -= sets.join(value, found)
                if apart == 1:
                    break
        tree.add(value)
    if others is not None:
        apart = len(values)
        for value in others:
            new = True
            for found in tree.near(value, radius):
                apart -= sets.join(value, found) and not new
                new = False
                if apart == 1:
                    break
    return list(sets.links())


def _keys(value: Column) -> Column:
    """One number per pair of bands: which pair, and the bits of both."""
    parts = [F.shiftrightunsigned(value, low).bitwiseAND((1 << bits) - 1) for low, bits in BANDS]
    return F.array(*[
        F.shiftleft(F.lit(n).cast("long"), 26).bitwiseOR(F.shiftleft(parts[i], 13)).bitwiseOR(parts[j])
        for n, (i, j) in enumerate(combinations(range(len(BANDS)), AGREE))
    ])


def links(values: DataFrame, radius: int = 3, tree_size: int = 1024) -> DataFrame:
    """(a, b): links within ``radius`` bits between the distinct numbers in column ``value``, enough to join what belongs together."""
    if radius > len(BANDS) - AGREE:
        raise ValueError(f"bands are laid out for a radius of at most {len(BANDS) - AGREE}")
    dealt = values.select("value", F.explode(_keys(F.col("value"))).alias("shard"))
    many = stored(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-shards")
    rows = dealt.join(many, "shard").withColumn("parts", F.ceil(F.col("n") / tree_size).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("value"), F.col("parts")).cast("int"))
    # Tree part i meets every part j > i as queries, and itself.
    tasks = F.concat(
        F.transform(F.sequence(F.col("own"), F.col("parts") - 1), lambda j: F.struct(F.col("own").alias("tree"), j.alias("query"))),
        F.transform(F.when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.struct(i.alias("tree"), F.col("own").alias("query"))),
    )
    rows = rows.select("shard", "own", "value", F.explode(tasks).alias("task")).select("shard", "task.tree", "task.query", "own", "value")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(key, own, value):
            tree, query = key[1], key[2]
            first = [v for o, v in zip(own, value) if o == tree]
            return _link(first, None if tree == query else [v for o, v in zip(own, value) if o != tree], radius)

        key, own, value = None, [], []
        for batch in batches:
            out = []
            edges = np.flatnonzero((batch[["shard", "tree", "query"]].diff() != 0).any(axis=1).to_numpy())
            marks = batch["shard"].tolist(), batch["tree"].tolist(), batch["query"].tolist()
            owns, values_ = batch["own"].tolist(), batch["value"].tolist()
            for low, high in zip(edges, [*edges[1:], len(batch)]):
                now = tuple(m[low] for m in marks)
                if now != key:
                    if key is not None:
                        out += done(key, own, value)
                    key, own, value = now, [], []
                own += owns[low:high]
                value += values_[low:high]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if key is not None:
            yield pd.DataFrame(done(key, own, value), columns=["a", "b"], dtype="int64")

    order = ["shard", "tree", "query"]
    return rows.repartition(*order).sortWithinPartitions(*order, "value").mapInPandas(releasing(search), "a long, b long")


def groups(marked: DataFrame, doc_id: str = "doc_id", mark: str = "mark", radius: int = 3, tree_size: int = 1024) -> DataFrame:
    """(mark, root, component_id) for every fingerprint: one of the component's, and the smallest non-null id in it; null where there is none."""
    classes = stored(marked.groupBy(F.col(mark).alias("value")).agg(F.min(doc_id).alias("least")), "simhash-classes")
    roots = components(links(classes.select("value"), radius, tree_size))
    joined = classes.join(roots.select(F.col("node").alias("value"), "root"), "value", "left")
    joined = stored(joined.select("value", "least", F.coalesce("root", "value").alias("root")), "simhash-roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # Only fingerprints in company need the join; the rest, nearly all, are their own component.
    company = least.where("n > 1").select("root", "component_id")
    out = joined.join(company, "root", "left")
    return out.select(F.col("value").alias(mark), "root", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 3, tree_size: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Texts without words, null ones among them, have fingerprint zero and are linked like any other. Repeated
    rows give a row each. A null id never names a component as long as a member has an id.
    An empty table gives no rows. Other columns are not read.
    """
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), width).alias("mark")), "simhash-marks")
    found = stored(groups(marked, radius=radius, tree_size=tree_size).select("mark", "component_id"), "simhash-groups")
    hexed = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    return marked.join(found, "mark").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 3, tree_size: int = 1024) -> DataFrame:
    """The rows of ``docs`` with one of each group of near-duplicates: the smallest id, null last, then the smaller hash of the text.

    The choice is made on ids and hashes; texts move once, to meet it. Repeated rows are one document.
    """
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), tie.alias("tie"), fingerprints(F.col(text), width).alias("mark")), "simhash-marks")
    roots = stored(groups(marked, radius=radius, tree_size=tree_size).select("mark", "root"), "simhash-groups")
    return first_of_each(docs, marked.join(roots, "mark"), text, doc_id)


def first_of_each(docs: DataFrame, grouped: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one of each root of ``grouped`` (doc_id, tie, root), chosen as ``one_of_each`` says."""
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    chosen = grouped.groupBy("root").agg(F.min(first).alias("first"))
    chosen = chosen.select(F.col("first.doc_id").alias("__id"), F.col("first.tie").alias("__tie"))
    rows = docs.withColumn("__own", tie)
    rows = rows.join(chosen, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tie")), "left_semi")
    return rows.dropDuplicates([doc_id, "__own"]).select(*docs.columns)

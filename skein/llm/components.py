"""Connected components of links: union-find inside every task, then contraction across tasks.

A round first reduces the links of each task to a forest by union-find. Then every
node takes the neighbour (or itself) with the smallest random rank, and links are carried over
to the nodes taken; links inside a node vanish. Ranks are a hash of the node, so a chain shrinks by a constant
share per round whatever its ids. All tables are written below ``spark.checkpoint.dir``; only
the number of links left reaches the driver.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import releasing, stored


class Sets:
    """Union-find; the smallest member stands for its set."""

    def __init__(self) -> None:
        self.parent: dict[Hashable, Hashable] = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a, b) -> bool:
        """True if two sets became one."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        return True

    def links(self) -> Iterable[tuple]:
        """A star per set: (member, smallest member)."""
        return ((x, root) for x in list(self.parent) if (root := self.find(x)) != x)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = Sets()
    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            sets.join(a, b)
    links = list(sets.links())
    yield pd.DataFrame({"a": [a for a, _ in links], "b": [b for _, b in links]})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that a link to another node names; nodes of one component, and no others, share a root.

    Repeated links, links of a node with itself and links with a null end change nothing. No links give no rows.
    """
    kind = links.schema[a].dataType
    shape = f"a {kind.simpleString()}, b {kind.simpleString()}"
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    edges = stored(edges.mapInPandas(releasing(_forest), shape), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("b"))
        taken = both.groupBy(F.col("a").alias("node")).agg(F.min(rank).alias("near"))
        taken = stored(taken.select("node", F.least("near", own)["b"].alias("root")), "taken")
        if roots is None:
            roots = taken
        else:
            moved = taken.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stored(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        left = taken.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = taken.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        carried = edges.join(left, "a").select("ra", "b").distinct().join(right, "b").where("ra <> rb")
        edges = stored(carried.select(F.col("ra").alias("a"), F.col("rb").alias("b")).mapInPandas(releasing(_forest), shape), "links")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

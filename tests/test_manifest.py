"""The hash tree of a corpus: fixed by the rows, and a way to the rows that differ."""

import hashlib

import pytest

from skein.operators import manifest as M
from skein.sources.snapshots import stored

ROWS = [(i, f"text {i % 40}", None if i % 9 == 0 else "|" * (i % 3)) for i in range(300)] + [(1, "text 1", "|")] * 50 + [(None, "", None)]
COLUMNS = ["id", "text", "note"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, note string")


def root(nodes):
    return nodes.where("depth = 0").first()


def plain(rows, depth):
    """Root by recursion over sorted leaves."""
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    leaves = [sha("|".join("-" if v is None else f"{len(str(v))}:{v}" for v in r)) for r in rows]

    def node(prefix, some):
        if len(prefix) == depth:
            return sha(",".join(sorted(f"{x}*{some.count(x)}" for x in set(some))))
        kids = sorted({x[: len(prefix) + 1] for x in some})
        return sha(",".join(f"{k}={node(k, [x for x in some if x.startswith(k)])}" for k in kids))

    return node("", leaves)


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_root_is_that_of_the_rows(spark, depth):
    nodes = M.manifest(frame(spark, ROWS), COLUMNS, depth)
    assert (root(nodes)["digest"], root(nodes)["rows"]) == (plain(ROWS, depth), len(ROWS))
    assert root(M.manifest(frame(spark, ROWS[::-1]).repartition(7), COLUMNS, depth))["digest"] == plain(ROWS, depth)


def test_rows_that_read_alike_differ(spark):
    a, b = [(1, "a|1:b", None)], [(1, "a", "1:b")]
    assert root(M.manifest(frame(spark, a), COLUMNS))["digest"] != root(M.manifest(frame(spark, b), COLUMNS))["digest"]


def test_changes_are_found_below_changed_nodes(spark):
    later = [r for r in ROWS if r[0] != 7]
    later[19] = (20, "changed", None)
    later += [(1, "text 1", "|"), (None, None, None)]
    a, b = frame(spark, ROWS), frame(spark, later)
    left, right = stored(M.manifest(a, COLUMNS), "manifest-a"), stored(M.manifest(b, COLUMNS), "manifest-b")
    buckets = stored(M.changed_buckets(left, right), "manifest-buckets")
    assert 1 <= buckets.count() <= 5
    found = {tuple(r) for r in M.changed_rows(a, b, COLUMNS, buckets).collect()}
    assert found == {(7, "text 7", "|", 1, 0), (20, *ROWS[20][1:], 1, 0), (20, "changed", None, 0, 1), (1, "text 1", "|", 51, 52), (None, None, None, 0, 1)}


def test_equal_and_empty_corpora(spark):
    a, none = frame(spark, ROWS), frame(spark, [])
    nodes, empty = (stored(M.manifest(d, COLUMNS), "manifest") for d in (a, none))
    assert M.changed_buckets(nodes, nodes).count() == 0 and empty.count() == 0
    assert M.changed_buckets(empty, nodes).count() == nodes.where(f"depth = {M.DEPTH}").count()

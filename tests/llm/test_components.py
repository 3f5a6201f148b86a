import random

import pytest

from skein.llm.components import Sets, components


def groups(pairs):
    sets = Sets()
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            sets.join(a, b)
    return {frozenset(x for x in sets.parent if sets.find(x) == r) for r in {sets.find(x) for x in sets.parent}}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(300)],
    [(0, i) for i in range(1, 300)] + [(500, 600)],
    [(1, 1), (2, None), (None, 3), (4, 5), (4, 5), (5, 4)],
    [random.Random(5).sample(range(400), 2) for _ in range(260)],
])
def test_components(spark, pairs):
    found = components(spark.createDataFrame([tuple(p) for p in pairs], "a long, b long").repartition(7)).collect()
    by = {}
    for row in found:
        by.setdefault(row["root"], set()).add(row["node"])
    assert {frozenset(v) for v in by.values()} == groups(pairs)
    assert len(found) == len({r["node"] for r in found})


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_binary_nodes(spark):
    found = components(spark.createDataFrame([(b"x", b"y"), (b"y", b"z")], "a binary, b binary")).collect()
    assert len({bytes(r["root"]) for r in found}) == 1 and len(found) == 3

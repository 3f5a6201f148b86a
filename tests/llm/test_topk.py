import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(c, T.StringType()) for c in ("slot", "dim", "row", "cells", "score")]])


def plain(rows, k, limit=2**63):
    """Every query row against every other row."""
    own = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, query) in enumerate(own):
        if q is None or q % 20:
            continue
        found = [(min(max(sum(x * y for x, y in zip(query, v)), -limit), limit - 1), i) for b, (i, v) in enumerate(own) if b != a and len(v) == len(query)]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, 0, *"xxxxx") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k, **options).collect()), key=repr)


@pytest.mark.parametrize("block_rows, query_rows", [(4096, 1024), (17, 3)])
def test_random(spark, block_rows, query_rows):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(40)]) for i in range(300)]
    assert run(spark, rows, block_rows=block_rows, query_rows=query_rows) == plain(rows, 5)


def test_ties_and_repeats(spark):
    """Few distinct vectors, repeated rows, one vector in a third of the rows."""
    rng = random.Random(2)
    kinds = [[rng.choice([-0.5, 0.25, 1.0]) for _ in range(20)] for _ in range(6)]
    rows = [(i, kinds[0] if i % 3 == 0 else rng.choice(kinds)) for i in range(150)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (21, rows[21][1])]
    assert run(spark, rows, block_rows=16) == plain(rows, 5)


def test_awkward(spark):
    rows = [(0, [0.1, 0.2]), (1, None), (2, [0.3, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [0.5, 0.5]), (None, None),
            (20, []), (21, []), (40, [1.0, 2.0, 3.0]), (-20, [-0.5, 1e-9]), (5, [0.01, -0.01]), (60, [0.0, -0.0])]
    assert run(spark, rows) == plain(rows, 5)


def test_large_values_stay_exact(spark):
    rows = [(0, [1e9, 1.0, -3.0]), (1, [1e9, 2.0, 7.0]), (2, [1e9, 3.0, 5.0]), (3, [1e15, 1e3, -2.0]), (20, [-1e9, 1.5, 2.5])]
    assert run(spark, rows) == plain(rows, 5)


def test_beyond_64_bits(spark):
    rows = [(0, [1e12, 1e12]), (1, [1e12, 1e12]), (2, [-1e12, 1.0])]
    assert run(spark, rows) == plain(rows, 5)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []

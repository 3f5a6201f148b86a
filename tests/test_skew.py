"""The two-level forms give the rows of the plain forms, whatever the keys' sizes."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import skew
from skein.operators.retrieval import nearest_rank
from skein.streaming import ledger as G


@pytest.fixture(scope="module", params=["some of many", "nine tenths in one", "5000 alike"])
def facts(spark, request):
    rnd = random.Random(3)
    rows = []
    for i in range(10_000 if request.param == "5000 alike" else 3000):
        if request.param == "5000 alike":
            key = f"k{i % 5000}"
        else:
            key = "hot" if rnd.random() < (0.9 if "nine" in request.param else 0.4) else f"k{rnd.randrange(300)}"
        rows.append((i, key, rnd.randrange(5000), rnd.random()))
    return spark.createDataFrame(rows, "id long, key string, at long, value double").repartition(7)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_numbered(facts):
    plain = facts.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at", "id")))
    ours = skew.numbered(facts, ["key"], ["at", "id"], F.floor(F.col("at") / 50), "n")
    assert rows(ours, "id", "n") == rows(plain, "id", "n")


def test_numbered_descending(facts):
    plain = facts.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("id"))))
    ours = skew.numbered(facts, ["key"], [F.desc("at"), F.desc("id")], F.floor(F.col("at") / 50), "n", True)
    assert rows(ours, "id", "n") == rows(plain, "id", "n")


def test_with_previous(facts):
    plain = facts.withColumn("prev_value", F.lag("value").over(Window.partitionBy("key").orderBy("at", "id")))
    ours = skew.with_previous(facts, ["key"], ["at", "id"], F.floor(F.col("at") / 500), ["value"])
    key = lambda r: r[0]
    assert sorted(((r.id, r.prev_value) for r in ours.collect()), key=key) == sorted(((r.id, r.prev_value) for r in plain.collect()), key=key)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, facts, how):
    dims = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("none", 4)], "key string, extra int")
    ours = skew.spread_join(facts, dims, ["key"], how)
    plain = facts.join(dims, "key", how)
    assert sorted(map(repr, ours.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_facts_of_a_key_are_dealt_out_and_dims_are_not_repeated_more_often_than_needed(spark):
    facts = spark.range(20_000).select(F.when(F.col("id") < 18_000, F.lit(0)).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
    plan = skew.spread_join(facts, facts.select("key").distinct().withColumn("x", F.lit(1)), ["key"])
    assert plan.count() == 20_000
    parts = facts.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(skew.SALTS))).where("key = 0").groupBy("part").count()
    assert parts.agg(F.max("count")).first()[0] < 18_000 / 30


@pytest.mark.parametrize("outlier", [0.0, 1e12])
def test_nearest_rank(spark, outlier):
    rnd = random.Random(8)
    values = [("g", rnd.random()) for _ in range(3000)] + [("g", outlier), ("one", 5.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {(r.g, r.share): r.value for r in nearest_rank(df, ["g"], "v", [0.5, 0.95, 1.0]).collect()}
    for g in ("g", "one", "same"):
        own = sorted(v for k, v in values if k == g)
        for share in (0.5, 0.95, 1.0):
            assert got[g, share] == own[max(1, math.ceil(share * len(own) - 1e-9)) - 1]


def test_sliding_log(spark):
    rnd = random.Random(5)
    events = [(i, "hot" if i % 2 else f"u{i % 5}", 1_700_000_000 + rnd.randrange(4000) / 4) for i in range(800)]
    df = spark.createDataFrame(events, "id long, user string, s double").select("id", "user", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("occurred_at"))
    got = {r.id: r.requests for r in G.sliding_log(df, ["user"], "id", 60).collect()}
    want = {i: sum(1 for _, v, y in events if v == u and 0 <= x - y < 60) for i, u, x in events}
    assert got == want


def test_top_n_limits_before_the_shuffle(facts):
    plan = skew.top_n(facts, ["key"], ["at", "id"], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_most_common(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbc"], "v string")
    assert [tuple(r) for r in skew.most_common(df, "v", 2).collect()] == [("a", 3), ("b", 2)]
    assert {tuple(r) for r in skew.most_common_approximately(df, "v", 2).collect()} == {("a", 3), ("b", 2)}

"""Sequences of flows with branches, joins and loops, and their frequent patterns."""

import random
from itertools import product

from skein.operators import flows as W
from skein.operators import patterns as P

SCHEMA = "doc_id long, step string, position int, element_ref string, targets array<string>, sequence string"


def frame(spark, flows):
    rows = [(doc, *step, "clash") for doc, steps in flows.items() for step in steps]
    return spark.createDataFrame(rows, SCHEMA)


def sequences(spark, flows):
    return {r["doc_id"]: r["sequence"] for r in W.flow_sequences(frame(spark, flows)).collect()}


def test_branches_joins_and_loops(spark):
    flows = {
        1: [("s", 0, "a_001", ["yes", "no"]), ("no", 1, "r_001", ["end"]), ("yes", 2, "d_001", ["end"]), ("end", 3, "a_002", None)],
        2: [("x", 0, "a_001", ["y"]), ("y", 1, "r_001", ["x", "z"]), ("z", 2, "d_001", ["z"])],
        3: [("b", 1, "r_001", []), ("a", 0, "a_001", ["gone"])],
        4: [("p", 0, "q_001", ["q"]), ("q", 1, None, ["r"]), ("r", 2, "d_9", None)],
        5: [("p", 0, "", None), (None, 1, "a_001", None)],
    }
    assert sequences(spark, flows) == {
        1: ["action", "directive", "action", "rule"],
        2: ["action", "rule", "directive"],
        3: ["action", "rule"],
        4: ["directive"],
    }


def test_repeated_steps_and_ties(spark):
    """The same rows in any order give the same sequence; the later row of a step counts."""
    steps = [("s", 0, "a_001", ["t"]), ("s", 0, "a_001", ["t"]), ("t", 5, "a_001", None), ("t", 5, "r_001", None), ("u", None, "d_001", None), ("v", 5, "a_1", None)]
    for seed in range(3):
        random.Random(seed).shuffle(steps)
        assert sequences(spark, {1: steps}) == {1: ["action", "rule", "directive", "action"]}


def test_a_long_flow(spark):
    steps = [(f"s{i}", i, "a_1" if i % 2 else "r_1", [f"s{i + 1}", "s0"]) for i in range(5000)]
    assert sequences(spark, {1: steps}) == {1: ["rule", "action"] * 2500}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.flow_sequences(empty).collect() == []


def test_patterns_equal_brute_force(spark):
    rng = random.Random(6)
    kinds = list(W.KINDS.values())
    rows = [[rng.choice(kinds) for _ in range(rng.randint(3, 9))] for _ in range(55)]
    rows += rows[:5]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id long, sequence array<string>")

    def within(pattern, row):
        rest = iter(row)
        return all(x in rest for x in pattern)

    want = {}
    for n in range(1, 5):
        for pattern in product(kinds, repeat=n):
            count = sum(within(pattern, r) for r in rows)
            if count >= 18:
                want["->".join(pattern)] = (n, count)
    got = {r["pattern"]: (r["length"], r["documents"]) for r in W.frequent_patterns(df, 0.3, 4).collect()}
    assert got == want
    assert any(n > 2 for n, _ in want.values())
    top = P.common_sequences(df).collect()
    assert all(r["occurrences"] == rows.count(r["pattern"].split("->")) > 1 for r in top) and top

import numpy as np
from llm.rows import AWKWARD

from skein.llm import quality


def test_held_out(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(documents, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 10
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, tie string, row string, id string")


def test_awkward(spark, frame):
    labels = labelled(spark, [(i, i % 2, 0, "x", "x", "x") for i in range(12)] + [(None, 1, 0, "x", "x", "x"), (3, None, 0, "x", "x", "x"), (5, 1, 0, "x", "x", "x"), (5, 7, 0, "x", "x", "x")])
    rows = quality.classify(frame(AWKWARD), labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    scores = {}
    for row, (doc_id, text, *_) in zip(sorted(rows, key=lambda r: repr(r["doc_id"])), sorted(AWKWARD, key=lambda r: repr(r[0]))):
        if doc_id in (5, 6):
            scores.setdefault(text, set()).add(row["score"])
    assert all(len(s) == 1 for s in scores.values())


def test_without_labels(spark, frame):
    rows = quality.classify(frame(AWKWARD), labelled(spark, [])).collect()
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert quality.classify(frame([]), labelled(spark, [])).collect() == []


def walked(forest, row):
    total = forest.base
    for at in forest.roots:
        while forest.children[at][0] != at:
            at = forest.children[at][int(row[forest.feature[at]] > forest.bound[at])]
        total += forest.value[at]
    return total


def test_flat_forest_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, 5))
    labels = ((rows[:, 0] > 0.2) ^ (rows[:, 1] > 0)).astype(float)
    forest = quality.grow(rows, labels, trees=25, depth=3)
    assert np.allclose(forest.margin(rows[:60]), [walked(forest, r) for r in rows[:60]])
    assert np.mean((forest.score(rows) >= 0.5) == labels) > 0.97


def test_first_split_is_the_best():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 6, size=(80, 3)).astype(float)
    labels = (rows[:, 2] + rng.normal(0, 1, 80) > 2.5).astype(float)
    forest = quality.grow(rows, labels, trees=1, depth=1)
    p = (labels.sum() + 0.5) / 81
    slope, weight = p - labels, np.full(80, p * (1 - p))

    def gain(f, bound):
        left = rows[:, f] <= bound
        if weight[left].sum() < 4 or weight[~left].sum() < 4:
            return 0
        part = lambda m: slope[m].sum() ** 2 / (weight[m].sum() + 1)
        return part(left) + part(~left) - part(left | True)

    best = max(((gain(f, b), f, b) for f in range(3) for b in range(6)), key=lambda x: x[0])
    root = forest.roots[0]
    assert np.isclose(gain(forest.feature[root], forest.bound[root]), best[0])


def test_statistics():
    rows = quality.statistics(["", "AB c1!\nxy", "ж" * 5])
    at = quality.FEATURES.index
    assert not rows[0].any()
    assert rows[1][at("chars")] == 9 and np.isclose(rows[1][at("letters")], 5 / 9) and rows[1][at("lines")] == 2
    assert rows[2][at("beyond_ascii")] == 1 and rows[2][at("letters")] == 1

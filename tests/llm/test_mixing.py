import random
import re

import pytest
from llm.rows import AWKWARD

from skein.llm import mixing


def seats(weights, n):
    """Seat by seat."""
    won = dict.fromkeys(weights, 0)
    for _ in range(n):
        best = min(((-w / (2 * won[k] + 1), -w, k) for k, w in weights.items() if w > 0), default=None)
        if best:
            won[best[2]] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportion_equals_seat_by_seat(spark, seed):
    rng = random.Random(seed)
    rows = []
    for group in "ab":
        n = rng.randint(0, 500)
        for i in range(rng.randint(1, 30)):
            rows.append((group, f"s{i:02}", float(rng.choice([0, 1, 5, 5, rng.randint(1, 10_000)])), n))
    df = spark.createDataFrame(rows, "g string, name string, weight double, seats long")
    got = {(r["g"], r["name"]): r["won"] for r in mixing.apportion(df, ["g"], ["g", "name"], "weight", "seats", "won").collect()}
    for group in "ab":
        own = {name: w for g, name, w, _ in rows if g == group}
        want = seats(own, next(n for g, *_, n in rows if g == group))
        assert {name: got[group, name] for name in own} == want


def target(sizes, weights=(3, 1, 2)):
    """Resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, x in share.items():
            out[s] += x
        for s in list(free):
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                free.discard(s)
    return out


def check(rows, df, slack):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    got = df.collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(((r[0], r[3], size(r[1])) for r in rows), key=repr)
    want = target(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack, s


def test_documents(documents):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()]
    check(rows, mixing.mix(documents), 25)


@pytest.mark.parametrize("shard_words", [50, 10_000])
def test_hot_source_in_shards(frame, shard_words):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), None, rng.choice(["hot", "hot", "hot", "a", None, "é", "b"])) for i in range(600)]
    check(rows, mixing.mix(frame(rows), shard_words=shard_words, block_words=1), 130 if shard_words == 50 else 20)


def test_awkward(frame):
    rows = [(*r, None, None)[:4] for r in AWKWARD]
    check(rows, mixing.mix(frame(AWKWARD), block_words=1), 3)


def test_reruns_agree(frame):
    rows = frame([(i, "a b c d e f " * (i % 7), None, f"s{i % 5}") for i in range(200)])
    run = lambda df: sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df).collect())
    assert run(rows) == run(rows.repartition(13))


def test_empty(frame):
    assert mixing.mix(frame([])).collect() == []
    assert [r["taken"] for r in mixing.mix(frame([(1, None), (2, "")])).collect()] == [0, 0]


def test_repeated(frame):
    docs = frame([(i, "some words of text here " * 3 + str(i), None, f"s{i % 3}") for i in range(90)])
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    times = {}
    for r in out.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: n for i, (t, s) in taken.items() if (n := int(t / s + 0.5))}

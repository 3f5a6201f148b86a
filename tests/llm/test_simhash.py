import random
import re

import numpy as np
import xxhash
from llm.rows import AWKWARD

from skein.llm import simhash
from skein.llm.components import Sets


def plain(text):
    """A fingerprint bit by bit."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))


def plain_groups(rows):
    marks = [plain(t) for _, t in rows]
    sets = Sets()
    for i in range(len(rows)):
        sets.find(i)
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                sets.join(i, j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets.find(j) == sets.find(i) and rows[j][0] is not None]
        out.append((doc_id, f"{marks[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(simhash.near_duplicates(documents)) == plain_groups(rows)


def test_awkward(frame):
    assert found(simhash.near_duplicates(frame(AWKWARD))) == plain_groups([r[:2] for r in AWKWARD])


def test_empty(frame):
    assert simhash.near_duplicates(frame([])).collect() == []


def balls(rng, groups, size):
    values = set()
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            value = centre
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
            values.add(value - (1 << 64) if value >> 63 else value)
    return sorted(values)


def test_links_join_all_within_the_radius(spark):
    """Small trees, so that shards are cut in many parts."""
    values = balls(random.Random(7), 12, 40)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "value long"), 3, tree_size=4).collect()
    got, want = Sets(), Sets()
    for v in values:
        got.find(v), want.find(v)
    for r in links:
        got.join(r["a"], r["b"])
    array = np.array(values, dtype="i8").view("u8")
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3):
            want.join(v, values[j])
    assert {v: got.find(v) for v in values} == {v: want.find(v) for v in values}


def test_tree_finds_all():
    rng = random.Random(3)
    values = balls(rng, 10, 30)
    tree = simhash.Tree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v, 3)) == sorted(w for w in values if ((v ^ w) & (2**64 - 1)).bit_count() <= 3)


def test_one_of_each(frame):
    kept = simhash.one_of_each(frame(AWKWARD))
    assert kept.columns == frame([]).columns
    rows = kept.collect()
    marks = [plain(r["text"]) for r in rows]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(marks) for b in marks[:i])
    assert sum(r["doc_id"] == 5 for r in rows) == 1 and all(r["doc_id"] != 6 for r in rows)

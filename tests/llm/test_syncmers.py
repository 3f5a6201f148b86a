import hashlib
import re
import struct

import pytest
import xxhash
from llm.rows import AWKWARD
from pyspark.sql import functions as F

from skein.llm import syncmers


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
    return seed


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def anchors(text):
    marks = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    if not marks:
        return []
    if len(marks) < 5:
        whole = xxhash.xxh64_intdigest(",".join(str(signed(m)) for m in marks).encode(), 42)
        return [(0, f"{whole & 0xFFFFFFFF:08x}")]
    inner = [signed(chained(marks[i : i + 2])) for i in range(len(marks) - 1)]
    out, last = [], 0
    for i in range(len(marks) - 4):
        run = inner[i : i + 4]
        if min(run) in (run[0], run[-1]):
            out.append((i - last, f"{chained(marks[i : i + 5]) & 0xFFFFFFFF:08x}"))
            last = i
    return out


def written(found):
    return "".join(f"{gap:x}{mark}" for gap, mark in found)


def alike(a, b):
    a, b = {m for _, m in a}, {m for _, m in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    texts = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    groups = {}
    for i, t in texts:
        groups.setdefault(i, []).append(t)
    texts = [(i, t) for i in dict.fromkeys(i for i, _ in texts) for t in sorted(groups[i], key=lambda t: t.encode())]
    out = []
    for at, (i, text) in enumerate(texts):
        after = texts[(at + 1) % len(texts)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        own, edited, other = anchors(text), anchors(edit), anchors(after)
        out.append((i, len(text), hashlib.sha256(edit.encode()).hexdigest(), written(own), written(edited), round(alike(own, edited), 12), round(alike(own, other), 12)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((*r[:5], round(r[5], 12), round(r[6], 12)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bucket_rows", [1, 13, 1000])
def test_documents(documents, bucket_rows):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(syncmers.edited_fingerprints(documents, bucket_rows=bucket_rows)) == plain(rows)


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_awkward(frame, bucket_rows):
    assert found(syncmers.edited_fingerprints(frame(AWKWARD), bucket_rows=bucket_rows)) == plain([r[:2] for r in AWKWARD])


@pytest.mark.parametrize("rows", [[], [(1, "alone in the world with some words")], [(None, "b"), (None, "a")], [(7, "x y z"), (None, None)]])
def test_few_rows(frame, rows):
    assert found(syncmers.edited_fingerprints(frame(rows))) == plain(rows)


def test_gaps_are_bounded(documents):
    for row in documents.limit(50).collect():
        assert all(gap <= syncmers.K - syncmers.S for gap, _ in anchors(row["text"]))


def test_anchors_do_not_depend_on_context(frame):
    passage = " ".join(f"word{i * 7919 % 101}" for i in range(60))
    rows = frame([(1, passage), (2, "other words stand before it here " + passage + " and after")])
    one, two = (r["f"] for r in rows.select("doc_id", syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("f")).orderBy("doc_id").collect())
    marks = lambda f: [f[i + 1 : i + 9] for i in range(0, len(f), 9)]
    assert "".join(marks(one)) in "".join(marks(two))


def test_positions(frame):
    text = " ".join(f"word{i * 31 % 57}" for i in range(40))
    rows = frame([(1, text), (2, "")]).select("doc_id", syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("fingerprint"))
    got = sorted((r["position"], r["mark"]) for r in syncmers.positions(rows).collect())
    at, want = 0, []
    for gap, mark in anchors(text):
        at += gap
        want.append((at, mark))
    assert got == want


def test_many_bounds(spark):
    """Buckets found in two steps equal a plain count of bounds."""
    from skein.llm.common import bucket_of

    bounds = [3 * i for i in range(1037)]
    place, exact = bucket_of(F.col("id"), bounds)
    for row in spark.range(0, 3108, 1).select("id", place.alias("p"), exact.alias("e")).collect():
        assert row["p"] == -(-row["id"] // 3) and row["e"] == (row["id"] % 3 == 0)

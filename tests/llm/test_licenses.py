import random
import re

import pytest
from llm.rows import AWKWARD

from skein.llm import licenses


def plain(rows, notices=licenses.NOTICES, share=0.8):
    """Every block against every notice."""
    out = []
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places, base, more, held = [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES:
            parts = phrase.split(" ")
            here = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
            places += here
            base |= {label} if here else set()
        for label, notice in notices:
            own = set(notice.split(" "))
            if len(own & set(words)) * 1000 < round(share * 1000) * len(own):
                continue
            for at in range(len(words)):
                both = len(own & set(words[at : at + 64]))
                if both * 1000 >= round(share * 1000) * len(own):
                    more.add(label)
                    held = max(held, both / len(own))
        out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else held))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents(documents):
    assert found(licenses.scan(documents)) == plain([(r["doc_id"], r["text"]) for r in documents.collect()])


CASES = [
    "Released under the MIT License. under THE mit-license!", "xunder the mit license", "under the mit licenses", "Apache License, Version 2.0", "CC BY-NC 4.0 cc by nc",
    "apache license version 22", "worK is licensed under the gnu general public license version 3", "under\x00the\x7fmit license é under the mité license",
    "under the mit license " * 300,
]


@pytest.mark.parametrize("start", [0, 7, *range(18, 36), 70])
def test_a_notice_with_other_words_between_is_found_wherever_it_starts(frame, start):
    notice = licenses.NOTICES[0][1].split(" ")
    spread = " ".join(w + " filler0" * (2 if n % 2 else 1) for n, w in enumerate(notice))
    rows = [(1, "before " * start + spread + " after" * 50)]
    assert found(licenses.scan(frame(rows))) == plain(rows)
    assert found(licenses.scan(frame(rows)))[0][6] == "mit"


def test_awkward(frame):
    rows = [(i, t) for i, t in enumerate(CASES)] + [r[:2] for r in AWKWARD]
    assert found(licenses.scan(frame(rows))) == plain(rows)


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_filters_lose_nothing(frame, share):
    """Parts of notices in noise, around the threshold, across block ends."""
    rng, rows = random.Random(6), []
    for doc_id in range(250):
        words = [rng.choice(["the", "of", "software", "license", "any", "lorem", "ipsum", "public"]) for _ in range(rng.randint(0, 120))]
        notice = rng.choice(licenses.NOTICES)[1].split(" ")
        part = [w for w in notice if rng.random() < rng.choice([0.6, 0.8, 0.95])]
        rng.shuffle(part)
        at = rng.randint(0, len(words))
        rows.append((doc_id, " ".join(words[:at] + part + words[at:])))
    got = found(licenses.scan(frame(rows), share=share))
    assert got == plain(rows, share=share) and any(r[6] for r in got)


def test_empty(frame):
    assert licenses.scan(frame([])).collect() == []


def test_long_notices_need_larger_windows(frame):
    with pytest.raises(ValueError):
        licenses.scan(frame([]), window=16)

"""Collocations against plain counting, and the summaries against exact counts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from skein.llm import phrases
from tests.llm.rows import AWKWARD


def cut(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain(rows, threshold, most):
    grams, mass = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in cut(text):
            mass[lang] += len(words)
            grams.update((lang, tuple(words[i : i + n])) for n in range(1, 6) for i in range(len(words) - n + 1))
    grams = {g: f for g, f in grams.items() if f >= threshold}
    covered = {}
    for (lang, g), f in grams.items():
        for n in range(2, len(g)):
            for i in range(len(g) - n + 1):
                part = lang, g[i : i + n]
                covered[part] = max(covered.get(part, 0), f)
    found = {}
    for (lang, g), a in grams.items():
        if len(g) > 1 and covered.get((lang, g), 0) < a:
            cuts = [(1000 * a * mass[lang] // (grams[lang, g[:k]] * grams[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), grams[lang, g[:k]], grams[lang, g[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, le, r, mass[lang], -score)
        for lang, some in found.items() for rank, (score, a, phrase, le, r) in enumerate(sorted(some)[:most], 1)
    )


def corpus():
    random.seed(3)
    words = ["the", "The", "of", "aé", "grüß", "x", "New", "york", "city", "\U0001f600"]
    texts = [" ".join(random.choices(words, k=random.randint(0, 40))).replace(" x ", random.choice([", ", "\n", "\t", "  ", ".. "])) for _ in range(150)]
    return [(i, t, random.choice(["en", "de", None, "und"]), "s") for i, t in enumerate(texts)]


def test_against_plain_counting(frame):
    for rows, threshold in ((corpus(), 4), (corpus(), 1), (AWKWARD, 2), ([], 2)):
        got = phrases.collocations(frame(rows), threshold, most=50)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, threshold, 50)


def test_one_hot_phrase(frame):
    rows = corpus() + [(1000 + i, "of the of the of the", "en", "s") for i in range(300)]
    got = phrases.collocations(frame(rows).repartition(7), 5)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5, 2000)


def test_full_bitmaps_change_nothing(frame):
    got = phrases.frequent(frame(corpus()), 4, bits=11)
    want = phrases.frequent(frame(corpus()), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_words():
    texts = ["", "A b\tc", "d.e f\n", " \n\x0b", "café É", "x" * 100_000, "\x00 a"]
    words = phrases.words_of(pa.array(texts))
    want = [(i, w, k + 1 < len(piece)) for i, t in enumerate(texts) for piece in cut(t) for k, w in enumerate(piece)]
    got = [words.data[a : a + n].tobytes().decode() for a, n in zip(words.start, words.size)]
    assert list(zip(words.text.tolist(), got, words.goes_on.tolist())) == want
    assert len(set(words.key.tolist())) == len(set(got))


def test_equal_hashes_are_told_apart():
    words = phrases.words_of(pa.array(["one two one three two"]))
    words.key[:] = 7
    assert phrases.exact_words(words).tolist() == [0, 1, 0, 2, 1]


def test_summary_keeps_every_frequent_key(monkeypatch):
    monkeypatch.setattr(phrases, "TOGETHER", 100)
    random.seed(5)
    for threshold in (3, 10, 50):
        drawn = [int(random.paretovariate(0.4)) % 5000 for _ in range(20_000)]
        blocks = []
        for at in range(0, len(drawn), 130):
            keys, counts = np.unique(np.array(drawn[at : at + 130], dtype="u8"), return_counts=True)
            blocks.append((keys, counts.astype("i8")))
        frequent = {k for k, n in Counter(drawn).items() if n >= threshold}
        kept = set(phrases.summary(blocks, threshold).tolist())
        assert frequent <= kept and len(kept) <= len(drawn) // threshold + 1


def test_products_past_64_bits(spark):
    row = spark.sql("select cast(9000000000000 as decimal(19,0)) a, cast(8000000000001 as decimal(19,0)) n")
    big = row.selectExpr("cast(cast(a * n as decimal(35,0)) * cast(1000 as decimal(4,0)) as decimal(38,0)) div cast(a * a as decimal(38,0)) s").first()["s"]
    assert big == 1000 * 9000000000000 * 8000000000001 // 9000000000000**2

"""The folded machine against plain kernels, sentences and units, and held-out accuracy on planted insults."""

import random

import numpy as np
import pytest

from skein.llm import toxicity
from tests.llm.rows import AWKWARD


def kernel(a, b):
    """The gap-weighted kernel of two units by its definition."""

    def embedded(unit):
        codes = [toxicity.BEGIN, *map(ord, unit), toxicity.END]
        out = {}
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(len(codes), i + toxicity.SPAN)):
                    key = codes[i], codes[j], codes[k]
                    out.setdefault(key, []).append(toxicity.DECAY ** (k - i + 1))
        return out

    x, y = embedded(a), embedded(b)
    scales = [sum(v * v for w in e.values() for v in w) ** 0.5 for e in (x, y)]
    return sum(sum(x[k]) * sum(y[k]) for k in x.keys() & y.keys()) / (scales[0] * scales[1])


WORDS = ["idiot", "idxiot", "clown", "cclown", "the", "a", "banana", "naïve", "日本", "stupidity"]


def test_kernel_values():
    marks = WORDS[:6]
    got = toxicity.landmark_weights(marks).of(toxicity.spelled(WORDS))
    assert np.allclose(got, [[kernel(w, m) for m in marks] for w in WORDS])
    assert kernel("idiot", "idxiot") > kernel("idiot", "clown")


@pytest.mark.parametrize("cells", [toxicity.MOST_CELLS, 0])
def test_folded_machine_is_the_nystrom_machine(monkeypatch, cells):
    monkeypatch.setattr(toxicity, "MOST_CELLS", cells)
    space = toxicity.Space(WORDS[:6])
    signs = np.array([1, 1, 1, -1, -1, -1, 1, -1, 1, -1.0])
    w = toxicity.svm(space.rows(WORDS), signs, np.ones(len(WORDS)))
    machine = space.folded(w)
    assert (machine.folded.table is None) == (cells == 0)
    assert np.allclose(machine.folded.of(toxicity.spelled(WORDS))[:, 0] + machine.bias, space.rows(WORDS) @ w[:-1] + w[-1], atol=1e-4)


def test_units_and_sentences():
    texts = ["One two. You i d i o t, ok? x*y", "", "...", "a\nb " + "z" * 70, "e.g. this\n"]
    units = toxicity.units_of(texts)
    got = [(int(units.text[i]), int(units.sentence[i]), toxicity.spell(units, i)) for i in range(len(units.size))]
    named = [(t, u) for t, _, u in got]
    assert named == [
        (0, "one"), (0, "two"), (0, "you"), (0, "idiotok"), (0, "xy"), (3, "a"), (3, "b"), *[(3, "z" * n) for n in (32, 32, 32, 22)], (4, "eg"), (4, "this"),
    ]
    spans = [texts[int(units.text[i])][slice(*units.spans[units.sentence[i]])].strip() for i in range(5)]
    assert spans == ["One two.", "One two.", "You i d i o t, ok?", "You i d i o t, ok?", "x*y"]


def corpus(n):
    random.seed(11)
    part = ["an", "er", "th", "in", "ou", "re", "st", "ble", "ly", "on"]
    bad = ["idiot", "scum", "moronic", "stupid", "trashy"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(random.choices(part, k=random.randint(1, 4))) for _ in range(random.randint(10, 80))]
        toxic = i % 4 == 0
        if toxic:
            word = random.choice(bad)
            form = random.choice([word, " ".join(word), "*".join(word), word.upper(), word + "!"])
            words.insert(random.randint(0, len(words)), form)
        for at in range(8, len(words), 9):
            words[at] += "."
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_planted_insults(spark, frame):
    docs, labels = corpus(800)
    got = toxicity.classify(frame(docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want, texts = dict(labels), {d[0]: d[1] for d in docs}
    held = [r for r in got if r.held_out]
    caught = [r.predicted for r in held if want[r.doc_id]]
    spared = [r.predicted for r in held if not want[r.doc_id]]
    assert len(got) == 800 and sum(caught) / len(caught) > 0.9 and sum(spared) / len(spared) < 0.05
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert 0 <= r.sentence_start <= r.sentence_end <= len(texts[r.doc_id])
    again = toxicity.classify(frame(docs).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {r.doc_id: round(r.score, 6) for r in again} == {r.doc_id: round(r.score, 6) for r in got}


def test_known_words_in_other_spellings_and_long_texts(spark, frame):
    docs, labels = corpus(800)
    clean = [text for i, text, *_ in docs if i % 4]
    forms = ["1d10t", "5cum", "$tup1d", "m0r0n1c", "tr@shy", "idiooot", "scúm", "moronically", "stupid"]
    made = [(10_000 + 4 * i, " ".join([*clean[i : i + 12], form, *clean[i + 12 : i + 24]]), "en", "s") for i, form in enumerate(forms * 4)]
    plain = [(20_000 + i, " ".join(clean[i : i + 24]), "en", "s") for i in range(0, 200, 4)]
    got = toxicity.classify(frame(docs + made + plain), spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id >= 10000").collect()
    caught = [r.predicted for r in got if r.doc_id < 20_000]
    spared = [r.predicted for r in got if r.doc_id >= 20_000]
    assert len(caught) == 36 and sum(caught) / len(caught) > 0.9 and sum(spared) / len(spared) < 0.1


def test_beginnings_of_units():
    units = toxicity.spelled(["loser", "loserly", "looser", "löser", "closer"])
    found = toxicity.lexicon(np.array([k for k, own in toxicity.heads(toxicity.spelled(["loser"])) for k in k[own == 0]]), np.arange(1.0, 4.0)).of(units)
    assert found[0] == found[2] == found[3] == 3 and 0 < found[1] < 3 and found[4] == 0
    assert toxicity.spell(toxicity.spoiled(units, np.array([4.0, 0, 0, 0, 0])), 0) == "l#ser"


def test_awkward_rows(spark, frame):
    docs, labels = corpus(300)
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7), (1, 0), (1, 1)], "doc_id long, toxic int")
    rows = [(i if i is None or abs(i) > 1000 else i + 1000, *r) for i, *r in AWKWARD]
    got = toxicity.classify(frame(docs + rows), known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "sentence_start", "sentence_end"]
    assert got.count() == len(docs) + len(rows)
    assert toxicity.classify(frame([]), known).count() == 0
    empty = known.limit(0)
    assert {(r.score, r.predicted) for r in toxicity.classify(frame(rows), empty).collect()} == {(0.0, 0)}

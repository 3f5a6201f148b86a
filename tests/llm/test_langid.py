import numpy as np
from llm.rows import AWKWARD

from skein.llm import langid


def test_held_out(documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward(frame):
    rows = langid.identify(frame(AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" for i in (1, 2, 3, -9))
    assert by[4]["lang_pred"] != "und" and by[11]["lang_pred"] != "und"
    assert by[5]["lang_pred"] == by[6]["lang_pred"]
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "fr", "und"}


def test_score_is_the_posterior():
    """Against counts taken run by run."""
    texts, labels = ["the cat and the dog", "der hund und die katze", "le chat et le chien"], [0, 1, 2]
    counts = np.zeros((1 << 10, 3))
    for text, label in zip(texts, labels):
        codes, owner, _ = langid.letters([text])
        for order in langid.ORDERS:
            np.add.at(counts, (langid.buckets(codes, owner, order, 10)[0], label), 1)
    weights = np.log((counts + 0.1) / (counts + 0.1).sum(0)).astype("f4")
    model = langid.Model(["en", "de", "fr"], np.log(np.full(3, 1 / 3)), weights, 10)
    tests = ["the dog", "und der", "", "le", "chien et chat", "?"]
    names, scores = langid.score(tests, model)
    for text, name, score in zip(tests, names, scores):
        total = model.prior.copy()
        codes, owner, _ = langid.letters([text])
        for order in langid.ORDERS:
            for bucket in langid.buckets(codes, owner, order, 10)[0]:
                total = total + weights[bucket]
        share = np.exp(total - total.max())
        if any(c.isalpha() for c in text):
            assert name == model.languages[total.argmax()] and abs(score - (share / share.sum()).max()) < 1e-6
        else:
            assert name == "und" and score == 1


def test_letters_collapse():
    codes, owner, some = langid.letters(["A1b  C", "", "..", "x"])
    assert "".join(map(chr, codes)) == "a b c  x" or "".join(map(chr, codes[owner == 0])) == "a b c"
    assert some.tolist() == [True, False, False, True]


def test_without_labels(frame):
    rows = langid.identify(frame([(1, "some text"), (2, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2
    assert langid.identify(frame([])).collect() == []
    assert [r["doc_id"] for r in langid.accepted(frame([(1, "some text"), (2, None), (3, "1 2")])).collect()] == [1]


def test_accepted_keeps_columns(frame):
    kept = langid.accepted(frame(AWKWARD))
    assert kept.columns == frame([]).columns
    assert {1, 2, 3, -9}.isdisjoint(r["doc_id"] for r in kept.collect())

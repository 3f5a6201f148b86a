import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm.rows import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import tokenfiles
from skein.llm.remembered import Words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.integers(2**16 - 2, 2**16 + 2))))
def test_pack(numbers):
    array = np.array(numbers, dtype="<u4")
    control, data = tokenfiles.pack(array)
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, -(-int(n).bit_length() // 8)) for n in numbers)
    assert tokenfiles.unpack(control, data, len(numbers)).tolist() == numbers


def test_format():
    control, data = tokenfiles.pack(np.array([1, 256, 65536, 2**24, 7]))
    assert control == bytes([0b11100100, 0]) and data == bytes([1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 7])


def expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(documents, tokenizer):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    got = tokenfiles.round_trip(documents, PATH, bucket_rows=7, block_ids=1000).collect()
    assert sorted(map(tuple, got)) == expected(tokenizer, rows)


def test_awkward(frame, tokenizer):
    got = [tuple(r) for r in tokenfiles.round_trip(frame(AWKWARD), PATH, bucket_rows=2).collect()]
    got.sort(key=lambda r: r[1])
    texts = sorted(AWKWARD, key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in texts]
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    assert sorted((r[0], 0, *r[2:]) for r in got if r[0] is not None) == sorted((r[0], 0, *r[2:]) for r in expected(tokenizer, [r[:2] for r in texts]) if r[0] is not None)
    assert sorted(map(key, got)) == sorted(map(key, expected(tokenizer, [r[:2] for r in texts])))


def test_empty(frame):
    assert tokenfiles.round_trip(frame([]), PATH).collect() == []


def test_read_gives_ids_ranked_by_frequency(spark, frame, tokenizer):
    folder, ranked = tokenfiles.store(frame([(1, "b b b"), (2, "a")]), PATH)
    ids = {r["doc_id"]: r["ids"] for r in tokenfiles.read(spark, folder, ranked).collect()}
    assert ids == {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in ((1, "b b b"), (2, "a"))}
    assert sorted(ranked[:2].tolist()) == sorted([2, tokenizer.encode(" b", add_special_tokens=False).ids[0]])


WORDS = st.text(alphabet="ab .,'\n\té😀<|>0", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=6))
def test_words_equal_whole_texts(texts):
    words = tokenfiles.words(Tokenizer.from_file(PATH).to_str())
    words.known.clear()
    whole = Tokenizer.from_file(PATH)
    words.before.clear()
    got, _ = words.ids(pa.array(texts))
    assert [g.tolist() for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_memory_stays_bounded(tokenizer):
    starts = np.array([n.startswith("Ġ") for n, _ in sorted(tokenizer.get_vocab().items(), key=lambda x: x[1])])
    words = Words(lambda t: [e.ids for e in tokenizer.encode_batch(t, add_special_tokens=False)], starts, "<u2", " ", False, most=50)
    for i in range(40):
        text = " ".join(f"w{j}" for j in range(i, i + 30))
        assert words.ids(pa.array([text]))[0][0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words.known) <= 110

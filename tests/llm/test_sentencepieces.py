import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm.rows import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from skein.llm import sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "a\n b", "日本語 テスト", "<s> </s> <0x41> <unk>", "a▁b ▁c", "tab\tx", " nb sp", "😀 😀😀", "x\n\ny  z", "a\x00b", "the " * 3000, "q" * 5000]


@pytest.fixture(scope="module")
def judge():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def form():
    return sp.rebuild(PATH)


def test_odd_texts(form, judge):
    codec = sp.codec(form, PATH)
    ids, fine = codec.encode(pa.array(ODD))
    assert [x.tolist() for x in ids] == judge.encode(ODD) and all(fine)
    assert codec.decode(ids) == [judge.decode(x) for x in judge.encode(ODD)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abeinst  .,\n\té日😀▁0", max_size=30), min_size=1, max_size=5))
def test_any_text(form, judge, texts):
    codec = sp.codec(form, PATH)
    ids, fine = codec.encode(pa.array(texts))
    assert [x.tolist() for x in ids] == judge.encode(texts) and all(fine)
    assert codec.decode(ids) == [judge.decode(x) for x in judge.encode(texts)]


def test_broken_bytes_decode_as_in_the_library(form):
    codec = sp.codec(form, PATH)
    ids = [codec.tokenizer.token_to_id(f"<0x{b:02X}>") for b in (0xE3, 0x81, 0x41, 0xFF)]
    assert codec.decode([np.array(ids, "<u4")]) == [codec.tokenizer.decode(ids, skip_special_tokens=False)]


def unigram(folder, extra):
    """A small unigram model made by hand: letters, a few words, byte pieces."""
    model = proto.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, True, 0
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.escape_whitespaces, model.normalizer_spec.remove_extra_whitespaces = True, extra
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    rows += [("▁", -2.0, 1), *[(c, -4.0 - i / 7, 1) for i, c in enumerate("abcdefgh")], ("▁ab", -3.1, 1), ("abc", -3.3, 1), ("cd", -3.7, 1), ("▁cde", -3.9, 1), ("fgh", -4.3, 1)]
    for piece, score, kind in rows:
        model.pieces.add(piece=piece, score=score, type=kind)
    path = str(folder / f"unigram{extra}.model")
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    return path


@pytest.mark.parametrize("extra", [False, True])
def test_unigram(tmp_path, extra):
    path = unigram(tmp_path, extra)
    codec, own = sp.Codec(sp.rebuild(path), path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["abcd abc", "ab cde fgh", "a é b", "abcdefgh" * 20, "  ab  cd ", "", "日"]
    ids, fine = codec.encode(pa.array(texts))
    assert [x.tolist() for x in ids] == own.encode(texts) and all(fine)


def test_report(frame, judge):
    rows = sp.report(frame(AWKWARD), PATH).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=repr)
    want = []
    for doc_id, text, *_ in AWKWARD:
        ids = judge.encode(text or "")
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got == sorted(want, key=repr)
    assert all(r["parity"] and r["round_trip"] for r in rows)
    assert sp.report(frame([]), PATH).collect() == []


def test_encode_and_decode_columns(frame, judge):
    docs = frame(AWKWARD)
    rows = sp.decode(sp.encode(docs, PATH, ids="numbers"), PATH, ids="numbers", text="back").collect()
    assert all(r["numbers"] == judge.encode(r["text"] or "") and r["back"] == (r["text"] or "") and r["parity"] for r in rows)


def test_a_wrong_word_is_told(form):
    class Other:
        def encode(self, texts, num_threads=1):
            return [[0] if "wrong" in t else codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    codec = sp.Codec(form, PATH)
    codec.judge = Other()
    assert codec.encode(pa.array(["all is well", "one wrong word", "  wrong"]))[1] == [True, False, False]

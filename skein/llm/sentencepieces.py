"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed and rebuilt: normaliser (character map, extra white space, dummy prefix), metaspace marker,
unigram scores or the merges that BPE scores imply, and byte fallback. Batches are encoded by several threads. Every
distinct word, and every text that is no row of words, is also encoded by the sentencepiece library; a text
whose ids differ has ``parity`` false.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.remembered import Words, slices, threads

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BYTE_NAME = re.compile("<0x[0-9A-F]{2}>")


def merges(scored: list[tuple[str, float]], known: set[str]) -> list[tuple[str, str]]:
    """The merges that a BPE model's scores imply: best piece first, every cut of it in two known pieces."""
    place = {piece: i for i, (piece, _) in enumerate(scored)}
    out = []
    for piece, score in scored:
        cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
        cuts.sort(key=lambda c: (place.get(c[0], -1), place.get(c[1], -1)))
        out.append((score, cuts))
    out.sort(key=lambda x: -x[0])
    return [cut for _, cuts in out for cut in cuts]


def rebuild(path: str) -> str:
    """The tokenizers library's form (JSON) of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    with open(path, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    trainer, norm = proto.trainer_spec, proto.normalizer_spec
    table = [(p.piece, p.score, p.type) for p in proto.pieces]
    unknown = table[trainer.unk_id][0]
    if trainer.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in table], unk_id=trainer.unk_id, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == BPE:
        scored = [(p, s) for p, s, kind in table if kind == NORMAL]
        model = models.BPE(
            {p: i for i, (p, _, _) in enumerate(table)}, merges(scored, {p for p, _ in scored}),
            unk_token=unknown, fuse_unk=True, byte_fallback=trainer.byte_fallback,
        )
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(" ")] if norm.add_dummy_prefix else []
    steps += [normalizers.Replace(" ", MARK)]
    tokenizer.normalizer = normalizers.Sequence(steps)
    # Pieces hold the marker at their start only, if anywhere, so a text may be cut before each run of markers.
    if all(MARK not in p.lstrip(MARK) for p, _, _ in table):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in table if kind == USER])
    end = [decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return tokenizer.to_str()


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, form: str, path: str | None) -> None:
        from tokenizers import Tokenizer

        threads(True)
        self.tokenizer = Tokenizer.from_str(form)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [name for name, _ in sorted(vocabulary.items(), key=lambda x: x[1])]
        starts = np.array([name.startswith(MARK) for name in self.names])
        self.raw = [bytes([int(n[3:5], 16)]) if BYTE_NAME.fullmatch(n) else n.replace(MARK, " ").encode() for n in self.names]
        shape = json.loads(form)
        self.prefix = prefix = any("Prepend" == step["type"] for step in shape["normalizer"]["normalizers"])
        self.judge = None
        if path:
            import sentencepiece

            self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        simple = prefix and shape["pre_tokenizer"] is not None and {s["type"] for s in shape["normalizer"]["normalizers"]} == {"Prepend", "Replace"}
        self.words = Words(self._raw, starts, "<u4", MARK, True, self._same if self.judge else None, most=120_000) if simple else None

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _same(self, texts: list[str], ids: list[bytes]) -> list[bool]:
        return [np.array(want, "<u4").tobytes() == got for want, got in zip(self.judge.encode(texts, num_threads=2), ids)]

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], list[bool | None]]:
        """Ids of texts, and whether they equal the other library's; null if that is not asked for."""
        if self.words is not None:
            ids, fine = self.words.ids(texts)
        else:
            plain = texts.to_pylist()
            ids = [np.array(x, "<u4") for x in self._raw(plain)]
            fine = self._same(plain, [x.tobytes() for x in ids]) if self.judge else []
        return ids, (fine if self.judge else [None] * len(ids))

    def forget(self) -> None:
        if self.words is not None:
            self.words.forget()

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts from ids: the pieces' bytes in a row; where these are not UTF-8, as the library's decoder mends them."""
        out, raw = [], self.raw.__getitem__
        for x in ids:
            numbers = x.tolist()
            try:
                text = b"".join(map(raw, numbers)).decode()
                out.append(text[1:] if self.prefix and text.startswith(" ") else text)
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(numbers, skip_special_tokens=False))
        return out


@lru_cache(maxsize=2)
def codec(form: str, path: str | None) -> Codec:
    return Codec(form, path)


def _codec_of(spark, path: str, verify: bool):
    form = spark.sparkContext.broadcast(rebuild(path))
    judge = path if verify else None
    return lambda: codec(form.value, judge)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", parity: str = "parity", verify: bool = True) -> DataFrame:
    """``docs`` with the ids of each text (array<int>) and whether they equal the sentencepiece library's (null unless ``verify``)."""
    get = _codec_of(docs.sparkSession, path, verify)

    @F.pandas_udf("ids array<int>, same boolean")
    def coded(texts: pd.Series) -> pd.DataFrame:
        found, fine = get().encode(pa.array(texts, pa.string()))
        return pd.DataFrame({"ids": [x.astype("i4") for x in found], "same": fine})

    made = docs.withColumn("__coded", coded(F.coalesce(F.col(text), F.lit(""))))
    return made.withColumns({ids: F.col("__coded.ids"), parity: F.col("__coded.same")}).drop("__coded")


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of each array of ids; null ids are a null text."""
    get = _codec_of(rows.sparkSession, path, False)

    @F.pandas_udf("string")
    def decoded(found: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else get().decode([np.asarray(x, "<u4")])[0] for x in found], dtype=object)

    return rows.withColumn(text, decoded(F.col(ids)))


def report(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip, parity for every row.

    Every whole text is encoded, decoded from its ids and compared (``round_trip``), and its ids with the sentencepiece library's (``parity``).
    A null text counts as empty: no ids, CRC 0. Repeated rows and null ids of documents are rows like others.
    An empty table gives no rows; other columns are not read.
    """
    get = _codec_of(docs.sparkSession, path, True)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"n_tokens": [], "ids_crc32": [], "round_trip": [], "parity": []}
            for part in slices(batch.column(1)):
                ids, fine = get().encode(part)
                made["n_tokens"] += [len(x) for x in ids]
                made["ids_crc32"] += [zlib.crc32(x.tobytes()) for x in ids]
                made["round_trip"] += [a == b for a, b in zip(part.to_pylist(), get().decode(ids))]
                made["parity"] += fine
            arrays = [pa.array(made["n_tokens"], pa.int64()), pa.array(made["ids_crc32"], pa.int64()), pa.array(made["round_trip"], pa.bool_()), pa.array(made["parity"], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *made])
        get().forget()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")

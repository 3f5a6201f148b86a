"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are reduced to lower-case letters with one space between runs of them. Runs of one to three characters
are hashed to ``2 ** bits`` buckets. Fitting counts buckets per language over a bounded sample; the
matrix of log probabilities (buckets by languages) is broadcast, and a batch of texts is scored in numpy as a
product of its sparse counts with that matrix: rows are looked up and summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.codes import flattened, lowered, mapped, pieces
from skein.llm.common import crc_mod, release, releasing

ORDERS = (1, 2, 3)
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
NONE = "und"
#: Buckets per row of counts.
PART = 1 << 12
#: Numbers in a work array of a batch.
CELLS = 1 << 20


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray
    bits: int


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced code points of all texts, the text of each, and whether each text has a letter."""
    codes, sizes = flattened(texts)
    codes = mapped(codes, lowered(), lambda c: ord(c.lower()[0]) if c.isalpha() else 32)
    owner = np.repeat(np.arange(len(texts), dtype="i4"), sizes)
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1] & (owner[1:] == owner[:-1])
    some = np.zeros(len(texts), dtype=bool)
    some[owner[~blank]] = True
    return codes[keep], owner[keep], some


def buckets(codes: np.ndarray, owner: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each run of ``order`` characters that lies in one text."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, dtype="i8"), np.zeros(0, dtype="i4")
    h = np.full(n, order, dtype="<u4") * np.uint32(0x27D4EB2F)
    for i in range(order):
        h = (h ^ codes[i : i + n]) * np.uint32(FACTORS[i])
        h ^= h >> np.uint32(15)
    whole = owner[:n] == owner[order - 1 :]
    return (h >> np.uint32(32 - bits))[whole], owner[:n][whole]


def score(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text; NONE and 1 without letters, NONE and 0 without a model."""
    if not model.languages:
        return [NONE] * len(texts), np.zeros(len(texts))
    names, sure = [], []
    for low, high in pieces(texts):
        codes, owner, some = letters(texts[low:high])
        total = np.tile(model.prior, (high - low, 1))
        step = max(1 << 14, CELLS // len(model.languages))
        for order in ORDERS:
            found, text = buckets(codes, owner, order, model.bits)
            for at in range(0, len(found), step):
                own = text[at : at + step]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[starts]] += np.add.reduceat(model.weights[found[at : at + step]], starts, axis=0, dtype="f8")
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        names += [model.languages[b] if s else NONE for b, s in zip(best, some)]
        sure.append(np.where(some, share, 1.0))
    return names, np.concatenate(sure) if sure else np.zeros(0)


def fit(rows: DataFrame, text: str, label: str, doc_id: str, per_language: int = 5000, bits: int = 16, smoothing: float = 0.1) -> Model:
    """A model from labelled rows, on a sample of about ``per_language`` texts of each language at most (by a hash of the id).

    Rows without text or label teach nothing. Priors come from all rows. Counts of the sample are added up
    on the executors; the driver gets one row per language, and the finished counts.
    """
    rows = rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), np.zeros((1 << bits, 0), dtype="f4"), bits)
    spark = rows.sparkSession
    rate = spark.createDataFrame([(lang, n, min(1.0, per_language / sizes[lang])) for n, lang in enumerate(languages)], "label string, number int, rate double")
    chance = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(rate), "label").where(chance < F.col("rate")).select("number", "text").repartition(16)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), 1 << bits), dtype="i8")
        for batch in batches:
            texts, numbers = batch["text"].tolist(), batch["number"].to_numpy("i8")
            for low, high in pieces(texts):
                codes, owner, _ = letters(texts[low:high])
                for order in ORDERS:
                    found, own = buckets(codes, owner, order, bits)
                    cells = numbers[low:high][own] * (1 << bits) + found
                    total += np.bincount(cells, minlength=total.size).reshape(total.shape)
        for lang, line in enumerate(total):
            parts = line.reshape(-1, PART)
            yield pd.DataFrame({"lang": lang, "part": np.arange(len(parts)), "counts": [p.tobytes() for p in parts]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "i8") for c in group["counts"])
        return group.iloc[:1].assign(counts=[total.tobytes()])

    shape = "lang int, part int, counts binary"
    found = sample.mapInPandas(releasing(count), shape).groupBy("lang", "part").applyInPandas(add, shape).collect()
    counts = np.zeros((1 << bits, len(languages)))
    for row in found:
        counts[row["part"] * PART : (row["part"] + 1) * PART, row["lang"]] = np.frombuffer(row["counts"], "i8")
    weights = np.log((counts + smoothing) / (counts + smoothing).sum(0)).astype("f4")
    prior = np.log(np.array([sizes[lang] for lang in languages]) / sum(sizes.values()))
    return Model(languages, prior, weights, bits)


def predict(docs: DataFrame, model: Model, text: Column) -> DataFrame:
    """``docs`` with ``__guess``: struct<lang string, score double>."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, sure = score(texts.tolist(), sent.value)
            yield pd.DataFrame({"lang": names, "score": sure})
        release()

    return docs.withColumn("__guess", guess(F.coalesce(text, F.lit(""))))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 4, fold: int = 2, per_language: int = 5000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the rows outside the held-out fold.

    The fold is crc32 of the id as text (null: the empty text) mod ``folds``. A text that is null or has no letter is ``und`` with score 1;
    if no row has a label, every text is ``und`` with score 0. Equal texts get equal answers; equal scores go to the first language by name.
    An empty table gives no rows. Other columns are not read.
    """
    held_out = crc_mod(doc_id, folds) == fold
    model = fit(docs.where(~held_out), text, lang, doc_id, per_language)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model, F.col("text")).select("doc_id", "held_out", F.col("__guess.lang").alias("lang_pred"), F.col("__guess.score").alias("score"))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: float = 0.5, per_language: int = 5000) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a language more probable than ``least``; the model learns as in ``identify``.

    Without labels there is no model, and every text with a letter stays.
    """
    model = fit(docs.where(crc_mod(doc_id, 4) != 2), text, lang, doc_id, per_language)
    lettered = docs.where(F.col(text).rlike(r"\p{L}"))
    if not model.languages:
        return lettered
    return predict(lettered, model, F.col(text)).where((F.col("__guess.lang") != NONE) & (F.col("__guess.score") >= least)).select(*docs.columns)

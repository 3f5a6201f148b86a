"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a row of statistics (shares of kinds of characters, words, lines, repetition). Trees
are grown on a bounded sample of labelled rows, on feature histograms of at most ``bins`` cells. The fitted forest is
flattened to arrays of feature, bound and children, and a batch of rows walks all trees at once in numpy.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.codes import BLANK, BREAK, DIGIT, LETTER, OTHER, PUNCTUATION, SYMBOL, flattened, kinds, mapped, pieces, uppers
from skein.llm.common import crc_mod

KINDS = (LETTER, DIGIT, BLANK, BREAK, PUNCTUATION, SYMBOL, OTHER)
FEATURES = (
    "chars", "letters", "digits", "blanks", "breaks", "punctuation", "symbols", "others", "uppers", "beyond_ascii",
    "words", "word_chars", "distinct_words", "top_word", "plain_words", "one_char_words", "upper_words",
    "lines", "distinct_lines", "short_lines", "ended_lines", "squeezed",
)
#: Bytes per block that is squeezed, so that a long text is measured like a short one.
BLOCK = 1 << 15


def _counted(text: str) -> list[float]:
    """Statistics of words and lines."""
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    m = max(1, len(lines))
    raw = text.encode()
    small = sum(len(zlib.compress(raw[at : at + BLOCK], 1)) for at in range(0, len(raw), BLOCK))
    return [
        len(words), sum(map(len, words)) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(k for w, k in counts.items() if w.isalpha()) / n, sum(k for w, k in counts.items() if len(w) == 1) / n,
        sum(k for w, k in counts.items() if w.isupper()) / n,
        len(lines), len(set(lines)) / m, sum(len(x) < 20 for x in lines) / m, sum(x.rstrip()[-1] in ".!?:;" for x in lines) / m,
        small / max(1, len(raw)),
    ]


def statistics(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for low, high in pieces(texts):
        part = texts[low:high]
        codes, sizes = flattened(part)
        owner = np.repeat(np.arange(len(part)), sizes)
        kind = mapped(codes, kinds(), lambda c: LETTER if c.isalpha() else OTHER)
        share = np.bincount(owner * len(KINDS) + kind, minlength=len(part) * len(KINDS)).reshape(len(part), -1)
        upper = np.bincount(owner, weights=mapped(codes, uppers(), str.isupper), minlength=len(part))
        high_codes = np.bincount(owner, weights=codes > 127, minlength=len(part))
        n = np.maximum(sizes, 1)
        out[low:high, 0] = sizes
        out[low:high, 1:8] = share / n[:, None]
        out[low:high, 8], out[low:high, 9] = upper / n, high_codes / n
        out[low:high, 10:] = [_counted(t) for t in part]
    return out


@dataclass
class Forest:
    """Trees in one set of arrays; a leaf is its own child on both sides."""

    roots: np.ndarray
    feature: np.ndarray
    bound: np.ndarray
    children: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(rows), 1))
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            right = rows[line, self.feature[at]] > self.bound[at]
            at = self.children[at, right.astype("i1")]
        return self.base + self.value[at].sum(1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -500, 500)))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, penalty: float = 1.0) -> Forest:
    """Boosted trees for 0/1 labels by logistic loss; level by level, each split by the best gain over histograms.

    ``least`` is the least hessian weight of a child, ``penalty`` the L2 term. With labels of one
    kind only, or none, every row scores their mean (0.5 without labels).
    """
    mean = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(mean / (1 - mean)))
    feature, bound, children, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0), bound.append(np.inf), children.append([len(value)] * 2), value.append(0.0)
        return len(value) - 1

    if len(set(labels.tolist())) > 1:
        width = rows.shape[1]
        cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        cells = binned + np.arange(width) * bins
        margin = np.full(len(rows), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            slope, weight = p - labels, p * (1 - p)
            roots.append(node())
            at, level = np.full(len(rows), roots[-1]), [roots[-1]]
            for _ in range(depth):
                place = {k: i for i, k in enumerate(level)}
                own = np.array([place.get(k, -1) for k in range(roots[-1], len(value))])[at - roots[-1]]
                live = own >= 0
                index = (own[live, None] * (width * bins) + cells[live]).ravel()
                shape = (len(level), width, bins)
                size = len(level) * width * bins
                slopes = np.bincount(index, np.repeat(slope[live], width), size).reshape(shape).cumsum(2)
                weights = np.bincount(index, np.repeat(weight[live], width), size).reshape(shape).cumsum(2)
                all_s, all_w = slopes[:, :1, -1:], weights[:, :1, -1:]
                gain = slopes**2 / (weights + penalty) + (all_s - slopes) ** 2 / (all_w - weights + penalty) - all_s**2 / (all_w + penalty)
                gain[(weights < least) | (all_w - weights < least)] = 0
                new = []
                for i, k in enumerate(level):
                    best = int(gain[i].argmax())
                    f, b = divmod(best, bins)
                    if gain[i, f, b] <= 1e-6 or b >= len(cuts[f]):
                        continue
                    feature[k], bound[k] = f, float(cuts[f][b])
                    children[k] = [node(), node()]
                    here = at == k
                    at[here] = np.where(binned[here, f] > b, children[k][1], children[k][0])
                    new += children[k]
                level = new
                if not level:
                    break
            for k in np.unique(at):
                here = at == k
                value[k] = float(-rate * slope[here].sum() / (weight[here].sum() + penalty))
                margin[here] += value[k]
    if not roots:
        roots.append(node())
    return Forest(np.array(roots), np.array(feature), np.array(bound), np.array(children), np.array(value), base, depth)


def fit(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, most_rows: int = 20_000) -> Forest:
    """A forest from about ``most_rows`` labelled rows at most, chosen by a hash of the id.

    The ids of the sample are bounded, so they are broadcast to the documents; the driver gets their statistics.
    Labels other than 0 and 1 and rows without id teach nothing. A null text has the statistics of an empty one.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label")).where("id is not null and label in (0, 1)")
    chance = F.pmod(F.xxhash64(F.lit("quality"), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(chance < min(1.0, most_rows / max(1, known.count())))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(texts.tolist())))

    found = rows.select("id", "label", measured(F.coalesce("text", F.lit(""))).alias("row")).toPandas()
    matrix = np.array(found["row"].tolist(), dtype="f8").reshape(len(found), len(FEATURES))
    # The order in which rows arrive must not change sums, and so the forest.
    order = np.lexsort((*matrix.T, found["label"].to_numpy("f8"), found["id"].to_numpy()))
    return grow(matrix[order], found["label"].to_numpy("f8")[order])


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", folds: int = 3, fold: int = 1, most_rows: int = 20_000
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learned from labels outside the held-out fold.

    The fold is crc32 of the id as text (null: the empty text) mod ``folds``. Only the text enters a score; a null text counts as empty. A
    document labelled twice teaches twice, repeated rows get a row each. Without usable labels every score is 0.5.
    An empty table gives no rows. Other columns are not read.
    """
    forest = fit(docs, labels.where(crc_mod(doc_id, folds) != fold), text, doc_id, label, most_rows)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(statistics(texts.tolist())))

    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(doc_id, folds) == fold).alias("held_out"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

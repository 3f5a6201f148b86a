"""Toxicity: a support vector machine with a subsequence string kernel, reduced by Nyström landmarks.

A text is cut into sentences and these into units: words without their punctuation, runs of very short words taken together ("i d i o t"), and overlapping windows of
very long ones. The kernel of two units counts the three-character subsequences they share, begin and end marks
included, each occurrence weighted by ``decay`` per character that it spans, so characters put in between lower it but do not break it. Subsequences that span more than ``SPAN``
characters count nothing, and a unit is scaled by its length. A sentence is as toxic as its worst unit; a document's score is a
logistic regression on the margin of its worst sentence and the numbers of its toxic and of all sentences.

Labels are those of documents, so the sentence that carries a label is found as the machine is trained: every round takes the worst
sentence of each document of a bounded sample by the machine so far. Landmarks span the space (Nyström): the machine is linear in their
kernel values, so all of it folds into one weight per subsequence, and a text is scored by looking its subsequences up, without any kernel
evaluation. The weights are broadcast; their number is bounded by the landmarks.

Beside the kernel stand the telling beginnings: whole units and their first characters that documents of label 1 hold far more often (``Lexicon``, of bounded size). They are
sure of a word that was seen, or of a known stem with another ending, where a kernel margin is not; the kernel is left with what was never seen. For both, digits and signs
that stand for letters count as these, and for beginnings repeated letters count once and accents may be left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.codes import BMP, flattened, lowered, mapped, pieces
from skein.llm.common import crc_mod, stored

#: Characters a counted subsequence may span, and the places of its second and third character.
SPAN = 5
SHAPES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
DECAY = 0.8
#: Begin and end marks, and the code of a blank.
BEGIN, END, BLANK = 1, 2, 32
#: Units have up to LONG characters; longer words are cut in windows that overlap by half. Words up to SHORT are glued to their like.
LONG, SHORT, RUN = 32, 2, 3
STOPS = ".!?\n。！？"
#: A sentence is toxic over this margin; margins are cut off at CLIP in a document's score.
HOT, CLIP = 0.6, 2.0
#: Least G squared of a telling unit, and units of either other sort that teach.
LEAST, USUAL = 20.0, 5000
#: Words whose kernel values are worked out together on the driver.
TOGETHER = 1000
#: Largest table of weights over all triples of characters.
MOST_CELLS = 1 << 23
MASK = (1 << 21) - 1
#: Digits and signs that are read as letters.
STANDS_FOR = dict(zip("0134578@$", "oieastbas"))
#: Lengths of beginnings, least G squared and log odds of a telling one, most of them, and log odds from which one is strong.
HEADS = range(4, 9)
SURE, ODDS, MOST_HEADS, STRONG = 30.0, 1.5, 20_000, 3.0
#: A character no unit has, put in to learn how a spoiled word looks, and the weight of a document with spoiled words.
SPOILT, SPOILED_SHARE = 35, 0.15
FIGURES = ["margin", "hot", "size", "known", "strong"]
PRIME = np.uint64(0x100000001B3)
FILTER = 1 << 22


@dataclass
class Units:
    """Units of some texts: their characters with marks in one array, where each begins, its length, sentence and text; and the span of each sentence."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    spans: np.ndarray


def _lower(codes: np.ndarray) -> np.ndarray:
    """Letters and digits in lower case, some digits and signs as the letters they stand for, white space as BLANK, all else as 0."""
    return mapped(codes, lowered_digits(), lambda c: ord(c.lower()[0]) if c.isalnum() else BLANK if c.isspace() else 0)


_TABLE: list[np.ndarray] = []


def lowered_digits() -> np.ndarray:
    if not _TABLE:
        table = lowered().copy()
        for code in range(len(table)):
            c = chr(code)
            table[code] = ord(STANDS_FOR.get(c) or c.lower()[0]) if c.isalnum() or c in STANDS_FOR else BLANK if c.isspace() else 0
        _TABLE.append(table)
    return _TABLE[0]


@lru_cache(maxsize=None)
def bare() -> np.ndarray:
    """For the first 65,536 code points: the letter without its accents."""
    return np.array([ord(unicodedata.normalize("NFD", chr(i))[0]) if not 0xD800 <= i < 0xE000 else i for i in range(BMP)], dtype="u4")


def heads(units: Units, accents: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the beginnings of units and of whole units, and the units they belong to. Repeated letters count once; without ``accents`` so do letters with and without."""
    codes = units.codes if accents else mapped(units.codes, bare(), ord)
    owner = np.repeat(np.arange(len(units.size)), units.size)
    keep = np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])]
    codes, owner = codes[keep].astype("u8"), owner[keep]
    size = np.bincount(owner, minlength=len(units.size))
    start = np.cumsum(size) - size
    own, key = np.arange(len(size)), np.zeros(len(size), "u8")
    # The first character is the begin mark, the last the end mark.
    for at in range(1, int(size.max(initial=0))):
        live = size[own] > at
        own, key = own[live], key[live]
        key = (key ^ codes[start[own] + at]) * PRIME
        key ^= key >> np.uint64(29)
        told = (size[own] > HEADS[0]) & ((size[own] == at + 1) | (at in HEADS))
        yield key[told], own[told]


@dataclass
class Lexicon:
    """Telling beginnings: their keys, rising, and log odds; ``there`` tells keys that cannot be among them by their last bits."""

    keys: np.ndarray
    odds: np.ndarray
    there: np.ndarray

    def of(self, units: Units) -> np.ndarray:
        """The largest log odds of each unit's beginnings, 0 without a telling one."""
        out = np.zeros(len(units.size))
        for accents in (True, False):
            for key, own in heads(units, accents):
                maybe = self.there[key & np.uint64(FILTER - 1)]
                key, own = key[maybe], own[maybe]
                if len(key):
                    place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    out[own] = np.maximum(out[own], np.where(self.keys[place] == key, self.odds[place], 0.0))
        return out


def lexicon(keys: np.ndarray, odds: np.ndarray) -> Lexicon:
    order = np.argsort(keys)
    there = np.zeros(FILTER, bool)
    there[keys & np.uint64(FILTER - 1)] = True
    return Lexicon(keys[order], odds[order], there)


def spoiled(units: Units, known: np.ndarray) -> Units:
    """The units with a character inside each strongly telling one spoiled, so that its beginnings are unknown."""
    codes, which = units.codes.copy(), np.flatnonzero((known >= STRONG) & (units.size > 4))
    codes[units.start[which] + 2 + which % np.minimum(units.size[which] - 4, 3)] = SPOILT
    return replace(units, codes=codes)


def units_of(texts: list[str]) -> Units:
    raw, sizes = flattened(texts)
    raw = raw.astype("u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = _lower(raw)
    # A stop ends a sentence if a blank or the end of the text follows; a line break always does.
    last = np.r_[owner[1:] != owner[:-1], True] if len(raw) else np.zeros(0, bool)
    stop = np.isin(raw, [ord(c) for c in STOPS]) & (last | (raw == 10) | (np.r_[codes[1:], np.uint32(BLANK)] == BLANK))
    edge = np.r_[True, stop[:-1] | last[:-1]] if len(raw) else np.zeros(0, bool)
    sentence = np.cumsum(edge) - 1
    first = np.flatnonzero(edge)
    final = np.r_[first[1:], len(raw)] - 1
    spans = np.stack([offset[first], offset[final] + 1], axis=1) if len(raw) else np.zeros((0, 2), "i8")
    keep = codes != 0
    codes, owner, sentence = codes[keep], owner[keep], sentence[keep]
    blank = codes == BLANK
    word = ~blank
    begins = word & np.r_[True, blank[:-1] | (sentence[1:] != sentence[:-1])] if len(codes) else word
    start = np.flatnonzero(begins)
    letters = np.cumsum(word)
    size = np.diff(np.r_[letters[start] - 1, letters[-1]]) if len(start) else np.zeros(0, "i8")
    codes, owner, sentence = codes[word], owner[word], sentence[word]
    start = np.cumsum(size) - size
    # Neighbouring short words of a sentence become one unit if there are RUN of them.
    short = size <= SHORT
    at = sentence[start] if len(start) else start
    joins = np.r_[False, short[1:] & short[:-1] & (at[1:] == at[:-1])] if len(start) else short
    group = np.cumsum(~joins) - 1
    members = np.bincount(group) if len(group) else group
    alone = ~joins | (members[group] < RUN)
    start = start[alone]
    size = np.diff(np.r_[start, len(codes)])
    # Windows over long units.
    step = LONG // 2
    windows = np.where(size > LONG, -(-(size - LONG) // step) + 1, 1)
    number = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    whole_start, whole_size = np.repeat(start, windows), np.repeat(size, windows)
    start = whole_start + number * step
    size = np.minimum(whole_size - number * step, LONG)
    marked = size + 2
    place = np.cumsum(marked) - marked
    out = np.empty(int(marked.sum()), dtype="u4")
    out[place], out[place + marked - 1] = BEGIN, END
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place + 1, size) + inner] = codes[np.repeat(start, size) + inner]
    return Units(out, place, marked, owner[start] if len(start) else start, sentence[start] if len(start) else start, spans)


def spell(units: Units, which: int) -> str:
    low = int(units.start[which])
    return "".join(map(chr, units.codes[low + 1 : low + int(units.size[which]) - 1].tolist()))


def subsequences(units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape: keys of the subsequences of all units, the place of their first character, and their weight."""
    codes, room = units.codes.astype("u8"), _room(units, "i8")
    for a, b in SHAPES:
        at = np.flatnonzero(room > b)
        yield codes[at] << np.uint64(42) | codes[at + a] << np.uint64(21) | codes[at + b], at, DECAY ** (b + 1)


def scale(size: np.ndarray) -> np.ndarray:
    """The length-scale of units with ``size`` characters (marks included): the norm of a unit without repetition."""
    total = sum(np.maximum(size - b, 0) * DECAY ** (2 * (b + 1)) for _, b in SHAPES)
    return np.sqrt(np.maximum(total, DECAY**6))


@dataclass
class Weights:
    """Rows of weights by subsequence; one column for a machine, one per landmark for kernel values.

    Where the characters that occur in ``keys`` are few, single columns are looked up in a table over all triples of them (``letters``, ``table``); else by binary search.
    """

    keys: np.ndarray
    values: np.ndarray
    letters: np.ndarray | None = None
    table: np.ndarray | None = None

    def of(self, units: Units) -> np.ndarray:
        """The sums of the weights of each unit's subsequences, by the unit's scale."""
        if self.table is not None:
            return self._summed(units)[:, None] / scale(units.size)[:, None]
        owner = np.repeat(np.arange(len(units.size)), units.size)
        total = np.zeros((len(units.size), self.values.shape[1]))
        for keys, at, weight in subsequences(units):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            place, own = place[hit], owner[at[hit]]
            if len(own):
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[starts]] += weight * np.add.reduceat(self.values[place], starts, axis=0)
        return total / scale(units.size)[:, None]

    def _summed(self, units: Units) -> np.ndarray:
        """The same for one column, without a list of keys: characters are numbered, and a triple's number is its place."""
        n = len(self.letters) + 1
        number = np.zeros(BMP, dtype="i4")
        low = self.letters < BMP
        number[self.letters[low]] = np.flatnonzero(low) + 1
        rest = {int(c): i + 1 for i, c in enumerate(self.letters) if c >= BMP}
        x = mapped(units.codes, number, lambda c: rest.get(ord(c), 0)).astype("i4")
        first, second = x * (n * n), x * n
        room = _room(units, "u1")
        total = np.zeros(len(x), dtype="f4")
        for a, b in SHAPES:
            if len(x) > b:
                cell = first[:-b] + second[a : len(x) - b + a]
                cell += x[b:]
                value = self.table[cell]
                value *= room[:-b] > b
                value *= np.float32(DECAY ** (b + 1))
                total[:-b] += value
        return np.add.reduceat(total, units.start, dtype="f8")


def _room(units: Units, kind: str) -> np.ndarray:
    """Characters left in the unit at each character, itself included."""
    return (np.repeat(units.start + units.size, units.size) - np.arange(len(units.codes))).astype(kind)


def weights(keys: np.ndarray, values: np.ndarray) -> Weights:
    parts = np.stack([keys >> np.uint64(42), keys >> np.uint64(21) & np.uint64(MASK), keys & np.uint64(MASK)])
    letters, place = np.unique(parts, return_inverse=True)
    n = len(letters) + 1
    if values.shape[1] != 1 or n**3 > MOST_CELLS:
        return Weights(keys, values)
    place = place.reshape(parts.shape) + 1
    table = np.zeros(n**3, dtype="f4")
    table[place[0] * n * n + place[1] * n + place[2]] = values[:, 0]
    return Weights(keys, values, letters.astype("i8"), table)


def spelled(words: list[str]) -> Units:
    """Units from their spellings."""
    size = np.array([len(w) + 2 for w in words], dtype="i8")
    codes = np.array([c for w in words for c in (BEGIN, *map(ord, w), END)], dtype="u4")
    start = np.cumsum(size) - size
    own = np.arange(len(words))
    return Units(codes, start, size, own, own, np.zeros((0, 2), "i8"))


def landmark_weights(words: list[str]) -> Weights:
    """Weights whose sums are a unit's kernel values with each landmark."""
    units = spelled(words)
    owner = np.repeat(np.arange(len(words)), units.size)
    parts = [(keys, owner[at], np.full(len(at), weight)) for keys, at, weight in subsequences(units)]
    keys, own, weight = (np.concatenate(x) for x in zip(*parts))
    distinct, place = np.unique(keys, return_inverse=True)
    values = np.zeros((len(distinct), len(words)))
    np.add.at(values, (place, own), weight / scale(units.size)[own])
    return weights(distinct, values)


@dataclass
class Machine:
    """The folded machine: margins of units, and the logistic line from a document's figures to its score."""

    folded: Weights
    bias: float
    line: np.ndarray | None = None
    lexicon: Lexicon | None = None

    def judge(self, texts: list[str], spoil: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each text its figures: its largest margin, its sentences over HOT, all its sentences, the largest log odds of its units, its units with strong ones; the span
        of its worst sentence, by margin and log odds together; and the worst unit there. ``spoil``: known words are spoiled first."""
        figures, spans, names = np.tile([-CLIP, 0.0, 0.0, 0.0, 0.0], (len(texts), 1)), np.zeros((len(texts), 2), "i8"), [""] * len(texts)
        for low, high in pieces(texts):
            units = units_of(texts[low:high])
            if not len(units.size):
                continue
            known = np.zeros(len(units.size)) if self.lexicon is None else self.lexicon.of(units)
            if spoil:
                units = spoiled(units, known)
                known = self.lexicon.of(units)
            margin = self.folded.of(units)[:, 0] + self.bias
            found = margin + known
            first = np.flatnonzero(np.r_[True, units.sentence[1:] != units.sentence[:-1]])
            worst = np.maximum.reduceat(margin, first)
            text = units.text[first]
            tops = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            here, begin = text[tops], first[tops]
            figures[low + here, 0] = np.maximum.reduceat(worst, tops)
            figures[low + here, 1] = np.add.reduceat((worst > HOT).astype("i8"), tops)
            figures[low + here, 2] = np.diff(np.r_[tops, len(text)])
            figures[low + here, 3] = np.maximum.reduceat(known, begin)
            figures[low + here, 4] = np.add.reduceat((known >= STRONG).astype("i8"), begin)
            # The first of its text's worst units.
            is_top = np.flatnonzero(found == np.repeat(np.maximum.reduceat(found, begin), np.diff(np.r_[begin, len(found)])))
            best = is_top[np.unique(units.text[is_top], return_index=True)[1]]
            spans[low + here] = units.spans[units.sentence[best]]
            for i, unit in zip(here.tolist(), best.tolist()):
                names[low + i] = spell(units, unit)
        return figures, spans, names

    def score(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(regressors(figures) @ self.line, -500, 500)))


def regressors(figures: np.ndarray) -> np.ndarray:
    margin, hot, size = np.clip(figures[:, 0], -CLIP, CLIP), np.log1p(figures[:, 1]), np.log1p(figures[:, 2])
    return np.stack([margin, hot, size, margin * size, figures[:, 3], np.log1p(figures[:, 4]), np.ones(len(figures))], axis=1)


def svm(rows: np.ndarray, signs: np.ndarray, cost: np.ndarray, start: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Weights, the bias last, that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y f)^2, by Newton steps from ``start``."""
    full = np.c_[rows, np.ones(len(rows))]
    w = np.zeros(full.shape[1]) if start is None else start
    ridge = np.r_[np.ones(rows.shape[1]), 1e-3]

    def loss(w: np.ndarray) -> float:
        return 0.5 * (ridge * w * w).sum() + (cost * np.maximum(0, 1 - signs * (full @ w)) ** 2).sum()

    for _ in range(steps):
        gap = 1 - signs * (full @ w)
        live = gap > 0
        slope = ridge * w - 2 * full[live].T @ (cost[live] * signs[live] * gap[live])
        bend = np.diag(ridge) + 2 * (full[live] * cost[live, None]).T @ full[live]
        move = np.linalg.solve(bend, slope)
        rate, now = 1.0, loss(w)
        while loss(w - rate * move) > now and rate > 1e-6:
            rate /= 2
        w = w - rate * move
        if now - loss(w) <= 1e-7 * now:
            break
    return w


def logistic(rows: np.ndarray, labels: np.ndarray, cost: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights of a logistic regression with a slight L2 term, by Newton steps."""
    line = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ line, -500, 500)))
        bend = (rows * (cost * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(rows.shape[1])
        move = np.linalg.solve(bend, rows.T @ (cost * (p - labels)) + 1e-2 * line)
        line = line - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return line


class Space:
    """Nyström coordinates: kernel values with the landmarks, times the inverse root of the landmarks' own."""

    def __init__(self, words: list[str]) -> None:
        self.kernel = landmark_weights(words)
        own = self.kernel.of(spelled(words))
        value, vector = np.linalg.eigh((own + own.T) / 2)
        self.root = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(words)))

    def rows(self, words: list[str]) -> np.ndarray:
        """Coordinates of words; those met before are kept."""
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            found = [self.kernel.of(spelled(new[at : at + TOGETHER])) @ self.root for at in range(0, len(new), TOGETHER)]
            self.known = np.concatenate([self.known, *found])
        return self.known[[self.place[w] for w in words]]

    def folded(self, w: np.ndarray) -> Machine:
        return Machine(weights(self.kernel.keys, (self.kernel.values @ (self.root @ w[:-1]))[:, None]), float(w[-1]))


def sample_of(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, most_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """id, text, label of about ``most_rows`` labelled documents of each kind at most, by a hash of the id, as a stored table; and the labels of each kind.

    An id counts once, with the largest of its labels and texts, however often it occurs. So the chosen ids are bounded, and are broadcast to the documents.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("label") == 1, min(1.0, most_rows / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most_rows / max(1, sizes.get(0, 0))))
    chosen = known.where(chance < rate).groupBy("id").agg(F.max("label").alias("label"))
    found = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = found.groupBy("id").agg(F.max(F.struct("label", "text")).alias("row")).select("id", "row.label", "row.text")
    return stored(rows, "toxicity-sample"), sizes


def telling(bad: Column, good: Column, n_bad: int, n_good: int) -> Column:
    """The log-likelihood ratio (G squared) of a unit's documents by kind; 0 where it is not more usual among the bad ones."""

    def part(k: Column, n: int, p: Column) -> Column:
        rest = F.lit(n) - k
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / (n * (1 - p)))).otherwise(0.0)

    p = (bad + good) / (n_bad + n_good)
    return F.when((bad / n_bad > good / n_good) & (p < 1), 2 * (part(bad, n_bad, p) + part(good, n_good, p))).otherwise(0.0)


def telling_heads(sample: DataFrame, n_bad: int, n_good: int) -> Lexicon | None:
    """The beginnings of units that documents of label 1 of the sample hold far more often than others; None if there are none."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, kind = batch["text"].tolist(), batch["label"].to_numpy("i8")
            for low, high in pieces(texts):
                units = units_of(texts[low:high])
                if not len(units.size):
                    continue
                key, own = (np.concatenate(x) for x in zip(*heads(units)))
                text = units.text[own]
                order = np.lexsort((text, key))
                key, text = key[order], text[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else np.zeros(0, bool)
                key, bad = key[new], kind[low:high][text[new]]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, "i8")
                if len(first):
                    total, bad = np.diff(np.r_[first, len(key)]), np.add.reduceat(bad, first)
                    yield pd.DataFrame({"key": key[first].view("i8"), "bad": bad, "good": total - bad})

    found = sample.select("label", "text").mapInPandas(counts, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    strength = telling(F.col("bad"), F.col("good"), n_bad, n_good)
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    rows = found.select("key", strength.alias("strength"), odds.alias("odds")).where(f"strength > {SURE} and odds > {ODDS}").orderBy(F.desc("strength"), "key").limit(MOST_HEADS).collect()
    return lexicon(np.array([r["key"] for r in rows], "i8").view("u8"), np.array([r["odds"] for r in rows])) if rows else None


def fit(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, most_rows: int = 4000, landmarks: int = 320, rounds: int = 4) -> Machine | None:
    """The machine for 0/1 labels of documents; None if labels of one kind are missing.

    ``most_rows`` bounds the documents of each kind that teach, ``landmarks`` the landmarks; the driver gets some ten thousand units (the
    telling ones, the most usual ones, others by hash) and one unit per sampled document and round. To learn that characters may be put in, the machine also sees
    telling units with a strange letter inside, and the document's line the documents of label 1 with their known words spoiled.
    """
    sample, share = sample_of(docs, labels, text, doc_id, label, most_rows)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None

    def spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, kind = batch["text"].tolist(), batch["label"].to_numpy("i8")
            for low, high in pieces(texts):
                units = units_of(texts[low:high])
                words = pd.DataFrame({"unit": [spell(units, i) for i in range(len(units.size))], "text": units.text}).drop_duplicates()
                own = kind[low:high][words["text"].to_numpy()]
                yield words.assign(bad=own, good=1 - own).groupby("unit", as_index=False)[["bad", "good"]].sum()

    found = sample.select("label", "text").mapInPandas(spellings, "unit string, bad long, good long")
    counted = stored(found.groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxicity-units")
    strength = telling(F.col("bad"), F.col("good"), sizes[1], sizes[0])
    worst = {r["unit"]: r["bad"] for r in counted.where(strength > LEAST).orderBy(strength.desc(), "unit").limit(3 * landmarks).collect()}
    others = counted.where((strength <= LEAST) & (F.col("good") > 0))
    usual = [r["unit"] for r in others.orderBy(F.desc("good"), "unit").limit(USUAL).collect()]
    mixed = [r["unit"] for r in others.orderBy(F.xxhash64("unit"), "unit").limit(USUAL).collect()]
    calm = dict.fromkeys(usual + mixed)
    space = Space(sorted({*apart(list(worst), 2 * landmarks // 3, 0.7), *apart(usual[:landmarks], landmarks // 6, 0.7), *apart(mixed[:landmarks], landmarks // 6, 0.7)}))
    strange = sorted({w[:i] + c + w[i:] for w in worst if len(w) < LONG for i in range(1, len(w)) for c in "xq"} - calm.keys() - worst.keys())
    known = telling_heads(sample, sizes[1], sizes[0])
    w = None
    for turn in range(rounds):
        words = [*worst, *calm, *strange]
        signs = np.r_[np.ones(len(worst)), -np.ones(len(calm)), np.ones(len(strange))]
        bad = np.array(list(worst.values()), dtype="f8")
        cost = np.r_[bad * len(calm) / max(1, bad.sum()), np.ones(len(calm)), np.full(len(strange), 0.1 * len(calm) / max(1, len(strange)))]
        w = svm(space.rows(words), signs, cost, w)
        machine = space.folded(w)
        machine.lexicon = known if turn + 1 == rounds else None
        sent = docs.sparkSession.sparkContext.broadcast(machine)

        def witness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                whole = [(0, batch)]
                if sent.value.lexicon is not None:
                    whole.append((1, batch[batch["label"] == 1]))
                for spoil, rows in whole:
                    figures, _, names = sent.value.judge(rows["text"].tolist(), bool(spoil))
                    yield pd.DataFrame({"label": rows["label"].to_numpy(), "spoil": spoil, "unit": names, **dict(zip(FIGURES, figures.T))})

        seen = sample.select("label", "text").mapInPandas(witness, "label int, spoil int, unit string, " + ", ".join(f"{c} double" for c in FIGURES)).toPandas()
        seen = seen.sort_values(["label", "spoil", *FIGURES, "unit"])
        if turn + 1 < rounds:
            calm.update(dict.fromkeys(u for u in seen["unit"][seen["label"] == 0] if u and u not in worst))
            named = seen["unit"][(seen["label"] == 1) & (seen["margin"] > HOT)].value_counts().sort_index()
            worst.update((u, int(n)) for u, n in named.items() if u not in worst and u not in calm)
    kind = seen["label"].to_numpy("f8")
    cost = np.where(kind == 1, share[1] / sizes[1], share[0] / sizes[0]) * np.where(seen["spoil"] == 1, SPOILED_SHARE, 1.0)
    machine.line = logistic(regressors(seen[FIGURES].to_numpy("f8")), kind, cost)
    return machine


def apart(words: list[str], most: int, near: float) -> list[str]:
    """The first ``most`` words that are no nearer than ``near`` to an earlier one."""
    if not words:
        return []
    kernel = landmark_weights(words).of(spelled(words))
    size = np.sqrt(np.maximum(np.diag(kernel), 1e-12))
    kernel = kernel / size[:, None] / size[None, :]
    out: list[int] = []
    for i in range(len(words)):
        if len(out) == most:
            break
        if not out or kernel[i, out].max() < near:
            out.append(i)
    return [words[i] for i in out]


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", folds: int = 4, fold: int = 2, least: float = 0.3, most_rows: int = 4000
) -> DataFrame:
    """doc_id, held_out, score, predicted, sentence_start, sentence_end for every row, learned from labels outside the held-out fold.

    The span is that of the text's worst sentence, in characters. The fold is crc32 of the id as text (null: the empty text) mod ``folds``. Only
    the text enters a score; a null text counts as empty, and a text without letters or digits has the least margin and no sentence (span 0, 0). Ties go to the first sentence. Without labels of both kinds every score is the share of label 1 (0 without labels). Very
    long texts are whole, repeated rows get a row each, an empty table gives none; other columns are not read.
    """
    usable = labels.where(crc_mod(doc_id, folds) != fold)
    machine = fit(docs, usable, text, doc_id, label, most_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(doc_id, folds) == fold).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if machine is None:
        share = usable.where(F.col(label).isin(0, 1)).agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0))).first()[0]
        made = rows.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(0).cast("long").alias("sentence_start"), F.lit(0).cast("long").alias("sentence_end"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(machine)

        @F.pandas_udf("score double, sentence_start long, sentence_end long")
        def judged(texts: pd.Series) -> pd.DataFrame:
            figures, spans, _ = sent.value.judge(texts.tolist())
            return pd.DataFrame({"score": sent.value.score(figures), "sentence_start": spans[:, 0], "sentence_end": spans[:, 1]})

        made = rows.withColumn("judged", judged("text")).select("doc_id", "held_out", "judged.*")
    return made.withColumn("predicted", (F.col("score") >= least).cast("int")).select("doc_id", "held_out", "score", "predicted", "sentence_start", "sentence_end")

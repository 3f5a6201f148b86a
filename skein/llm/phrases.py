"""Phrase collocations: frequent n-grams found by mergeable Misra-Gries summaries, then counted exactly.

Three passes over the texts, none of which holds more than a block of them:

1. n-grams of one and two words are hashed, pre-counted per block and dealt by hash to partitions. A partition merges its blocks
   in a Misra-Gries summary whose capacity exceeds mass / threshold, so what the summary takes off a counter stays below the threshold
   and every n-gram that reaches it survives. The survivors leave as a bitmap of fixed size, a slice per partition.
2. The same for longer n-grams, at places where every pair of neighbouring words is a survivor.
3. Occurrences of survivors are counted exactly, by their words; what the bitmaps let through wrongly falls here.

A bitmap decides how much the next pass sends on, never what the result is. Cuts, scores and the removal of phrases inside longer ones
are joins over the frequent n-grams: every part of a frequent phrase is itself frequent, so it is among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored
from skein.operators.skew import spread_join, top_n

#: What separates words, and what ends a piece of text: fixed values.
BETWEEN = b" \t"
ENDS = b".,;:!?\n\x0b\x0c\r"
NO_LANGUAGE = "und"
LONGEST = 5
#: Bytes of text worked on together, and n-grams counted together.
BLOCK = 1 << 22
TOGETHER = 1 << 21
#: Rows of counts that a task holds before it sends them on.
HELD = 1 << 20
#: Bytes of text per hash partition, the least number of partitions (powers of two), and the bits of a pass's bitmap.
PART_BYTES = 1 << 23
LEAST_PARTS = 256
BITS = 27

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte (0 word, 1 between words, 2 end of a piece), and a number of 64 bits for each."""
    kind = np.zeros(256, dtype="u1")
    kind[list(BETWEEN)], kind[list(ENDS)] = 1, 2
    return kind, mixed(np.arange(1, 257, dtype="u8") * np.uint64(BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        steps = np.full(n, base, dtype="u8")
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


@dataclass
class Words:
    """The words of some texts in order: bytes of all texts, start and length of each word, its text, its hash, and whether the next word is in the same piece."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    key: np.ndarray
    goes_on: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Cuts lower-cased (A-Z) texts in pieces and words, with numpy on their bytes."""
    lowered = pc.ascii_lower(texts)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lowered)], pa.int32()), lowered), "\n")[0].as_buffer()
    data = np.frombuffer(joined, "u1")
    ends = np.cumsum(np.asarray(pc.binary_length(lowered)) + 1)
    kinds, numbers = _tables()
    kind = kinds[data]
    edge = np.diff(np.r_[np.uint8(0), (kind == 0).view("u1"), np.uint8(0)].view("i1"))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        none = np.zeros(0, dtype="i8")
        return Words(data, none, none, none, none.astype("u8"), np.zeros(0, dtype=bool))
    goes_on = np.maximum.reduceat(kind, start) < 2
    goes_on[-1] = False
    n = max(BLOCK, 1 << int(len(data) - 1).bit_length())
    up, down = _powers(n)
    total = np.cumsum(numbers[data] * up[: len(data)])
    key = (total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))) * down[start]
    return Words(data, start, end - start, np.searchsorted(ends, start, side="right"), mixed(key + (end - start).astype("u8")), goes_on)


def places(goes_on: np.ndarray, longest: int) -> list[np.ndarray]:
    """For n of 1 to ``longest``: whether a row of n words of one piece starts at each word."""
    fits = [np.ones(len(goes_on), dtype=bool)]
    for n in range(2, longest + 1):
        step = np.zeros(len(goes_on), dtype=bool)
        step[: max(0, len(goes_on) - n + 2)] = goes_on[n - 2 :]
        fits.append(fits[-1] & step)
    return fits


def keys_at(key: np.ndarray, own: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the rows of n words at ``at``; ``own`` is the hash of each word's language."""
    total = own[at] + np.uint64(n)
    for i in range(n):
        total = total + key[at + i] * np.uint64(STEPS[i])
    return mixed(total)


def passes(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = keys >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1")) & np.uint8(1) > 0


def summary(blocks: list[tuple[np.ndarray, np.ndarray]], threshold: int) -> np.ndarray:
    """Keys that may reach ``threshold``, from blocks of (keys, counts): a merged Misra-Gries summary.

    Its capacity exceeds mass / threshold. If counters outgrow it, the largest that does not fit is taken off all; all that is
    ever taken off one key stays below mass / capacity, so below the threshold, and is added again for the last decision.
    """
    mass = int(sum(int(n.sum()) for _, n in blocks))
    capacity = mass // threshold + 1
    keys, counts, taken, waiting, size = np.zeros(0, "u8"), np.zeros(0, "i8"), 0, [], 0
    for i, block in enumerate(blocks):
        waiting.append(block)
        size += len(block[0])
        if size < TOGETHER and i + 1 < len(blocks):
            continue
        keys, place = np.unique(np.concatenate([keys, *[k for k, _ in waiting]]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, *[n for _, n in waiting]]), len(keys)).astype("i8")
        waiting, size = [], 0
        if len(keys) > capacity:
            off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            taken += off
            keep = counts > off
            keys, counts = keys[keep], counts[keep] - off
    return keys[counts + taken >= threshold]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Texts, languages and language hashes of some neighbouring rows at a time, about BLOCK bytes; a longer text stands alone."""
    for batch in batches:
        texts, langs, own = batch.column(0), batch.column(1), np.asarray(batch.column(2)).view("u8")
        sizes = np.asarray(pc.binary_length(texts)).tolist()
        low, held = 0, 0
        for at, size in enumerate(sizes):
            if held and held + size > BLOCK:
                yield texts[low:at], langs[low:at], own[low:at]
                low, held = at, 0
            held += size
        if low < len(sizes):
            yield texts[low:], langs[low:], own[low:]


def _dealt(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per hash partition: the 32 bits of each key after the partition's; keys met once go without a count."""
    keys, counts = np.unique(keys >> np.uint64(32 - bits), return_counts=True)
    cuts = np.searchsorted(keys >> np.uint64(32), np.arange((1 << bits) + 1, dtype="u8"))
    rows = {"part": [], "once": [], "more": [], "counts": []}
    short = keys.astype("<u4")
    for part, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if low < high:
            single = counts[low:high] == 1
            rows["part"].append(part)
            rows["once"].append(short[low:high][single].tobytes())
            rows["more"].append(short[low:high][~single].tobytes())
            rows["counts"].append(counts[low:high][~single].astype("<u4").tobytes())
    kinds = {"part": pa.int32(), "once": pa.binary(), "more": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_pydict({name: pa.array(rows[name], kind) for name, kind in kinds.items()})


def survivors(rows: DataFrame, grams: Callable[[Words, np.ndarray], list[np.ndarray]], threshold: int, part_bits: int, bits: int) -> np.ndarray:
    """A bitmap of ``1 << bits`` bits with the places of all n-gram hashes that may be frequent.

    ``grams`` gives a block's n-gram hashes. Every partition holds the n-grams of about PART_BYTES of text, so partitions grow in number, not in size.
    The driver gets one slice of the bitmap per partition: a fixed size in all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for texts, _, own in _blocks(batches):
            words = words_of(texts)
            for keys in grams(words, own[words.text] if len(words.text) else own[:0]):
                waiting.append(keys)
                size += len(keys)
                if size >= TOGETHER:
                    yield _dealt(np.concatenate(waiting), part_bits)
                    waiting, size = [], 0
        if size:
            yield _dealt(np.concatenate(waiting), part_bits)

    slice_bits = bits - part_bits

    def merge(table: pa.Table) -> pa.Table:
        blocks = []
        for once, more, counts in zip(*[table[c].to_pylist() for c in ("once", "more", "counts")]):
            keys = np.frombuffer(once + more, "<u4")
            n = np.r_[np.ones(len(once) // 4, "i8"), np.frombuffer(counts, "<u4").astype("i8")]
            blocks.append((keys, n))
        found = summary(blocks, threshold)
        on = np.zeros(1 << slice_bits, dtype="u1")
        on[found.astype("u8") >> np.uint64(32 - slice_bits)] = 1
        return pa.table({"part": table["part"][:1], "slice": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    dealt = rows.mapInArrow(count, "part int, once binary, more binary, counts binary")
    bitmap = np.zeros(1 << (bits - 3), dtype="u1")
    width = 1 << (slice_bits - 3)
    for row in dealt.groupBy("part").applyInArrow(merge, "part int, slice binary").collect():
        bitmap[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["slice"], "u1")
    return bitmap


def exact_words(words: Words) -> np.ndarray:
    """A number per word, equal for equal words only: hashes decide, and bytes are compared with those of the first word of each hash."""
    _, first, number = np.unique(words.key, return_index=True, return_inverse=True)
    like = first[number]
    same = words.size == words.size[like]
    total = int(words.size[same].sum())
    size = words.size[same]
    offset = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    equal = words.data[np.repeat(words.start[same], size) + offset] == words.data[np.repeat(words.start[like][same], size) + offset]
    if same.all() and equal.all():
        return number
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(words.data[a : a + n].tobytes(), len(seen)) for a, n in zip(words.start.tolist(), words.size.tolist())])


def frequent(docs: DataFrame, threshold: int = 100, text: str = "text", lang: str = "lang", longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """lang, phrase, n (words, 1 to ``longest``), f (occurrences, at least ``threshold``), and one row per language with n = 0 and the number of its words as f.

    Overlapping occurrences count. A null language is ``und``, a null text is empty; a language without words has no row.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(F.col(text).alias("text"), name.alias("lang"), F.xxhash64(name).alias("own")).where("length(text) > 0")
    mass = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = int(max(LEAST_PARTS, mass // PART_BYTES) - 1).bit_length()
    bits = max(bits, part_bits + 3)

    def short(words: Words, own: np.ndarray) -> list[np.ndarray]:
        fits = places(words.goes_on, min(2, longest))
        return [keys_at(words.key, own, np.flatnonzero(fit), n + 1) for n, fit in enumerate(fits)]

    pairs = spark.sparkContext.broadcast(survivors(rows, short, threshold, part_bits, bits))

    def open_places(words: Words, own: np.ndarray) -> np.ndarray:
        """Whether the word goes on with the next one as a pair that may be frequent."""
        at = np.flatnonzero(words.goes_on)
        on = np.zeros(len(words.goes_on), dtype=bool)
        on[at] = passes(pairs.value, keys_at(words.key, own, at, 2), bits)
        return on

    def long(words: Words, own: np.ndarray) -> list[np.ndarray]:
        fits = places(open_places(words, own), longest)
        return [keys_at(words.key, own, np.flatnonzero(fits[n - 1]), n) for n in range(3, longest + 1)]

    more = spark.sparkContext.broadcast(survivors(rows, long, threshold, part_bits, bits) if longest > 2 else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for texts, langs, own in _blocks(batches):
            words = words_of(texts)
            if not len(words.start):
                continue
            coded = langs.dictionary_encode()
            tongue = np.asarray(coded.indices).astype("i8")[words.text]
            hashes = own[words.text]
            fits = places(open_places(words, hashes), longest)
            number = exact_words(words)
            sizes = np.bincount(tongue, minlength=len(coded.dictionary))
            spoken = np.flatnonzero(sizes)
            first = np.array([int(np.argmax(tongue == i)) for i in spoken])
            found = [_Counted(hashes[first], coded.dictionary.take(pa.array(spoken)), pa.array([""] * len(spoken)), 0, sizes[spoken])]
            # A row of n words is numbered by the row of n - 1 words before it and its last word: exact at every length.
            before = tongue
            width = int(number.max()) + 1
            for n in range(1, longest + 1):
                at = np.flatnonzero(fits[n - 1])
                if not len(at):
                    break
                _, inverse = np.unique(before[at] * width + number[at + n - 1], return_inverse=True)
                before = np.zeros(len(number), dtype="i8")
                before[at] = inverse
                keys = keys_at(words.key, hashes, at, n)
                live = passes(pairs.value if n < 3 else more.value, keys, bits)
                counts = np.bincount(inverse[live], minlength=int(inverse.max()) + 1)
                where = np.zeros(len(counts), dtype="i8")
                where[inverse[live]] = np.flatnonzero(live)
                where = where[counts > 0]
                found.append(_Counted(keys[where], coded.dictionary.take(pa.array(tongue[at[where]])), _joined(words, number, at[where], n), n, counts[counts > 0]))
            held = [_summed([*held, *map(_Counted.table, found)])]
            if len(held[0]) > HELD:
                yield _packed(held[0], part_bits)
                held = []
        if held:
            yield _packed(held[0], part_bits)

    def add(table: pa.Table) -> pa.Table:
        columns = [pc.list_flatten(table[c].combine_chunks()) for c in ("lang", "phrase", "n", "f")]
        whole = pa.table(dict(zip(("lang", "phrase", "n", "f"), columns))).group_by(["lang", "phrase", "n"]).aggregate([("f", "sum")])
        whole = whole.rename_columns({"f_sum": "f"})
        return whole.filter(pc.or_(pc.greater_equal(whole["f"], threshold), pc.equal(whole["n"], 0)))

    dealt = rows.mapInArrow(count, "part int, lang array<string>, phrase array<string>, n array<int>, f array<long>")
    return dealt.groupBy("part").applyInArrow(add, "lang string, phrase string, n int, f long")


@dataclass
class _Counted:
    """Rows of n words with their hashes, languages, words and occurrences in a block."""

    key: np.ndarray
    lang: pa.Array
    phrase: pa.Array
    n: int
    f: np.ndarray

    def table(self) -> pa.Table:
        return pa.table({"key": self.key, "lang": self.lang, "phrase": self.phrase, "n": np.full(len(self.f), self.n, dtype="i4"), "f": self.f.astype("i8")})


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Occurrences of equal rows of words, added up."""
    keys = ["key", "lang", "phrase", "n"]
    return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("f", "sum")]).rename_columns([*keys, "f"])


def _joined(words: Words, number: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The n words from each place on, with a space between."""
    used, first, place = np.unique(number[(at[:, None] + np.arange(n)).ravel()], return_index=True, return_inverse=True)
    where = (at[:, None] + np.arange(n)).ravel()[first].tolist()
    names = pa.array([words.data[words.start[i] : words.start[i] + words.size[i]].tobytes().decode() for i in where], pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * n, pa.int32()), names.take(pa.array(place.ravel()))), " ")


def _packed(table: pa.Table, part_bits: int) -> pa.RecordBatch:
    """One row per hash partition with all that a task found for it."""
    part = (np.asarray(table["key"]) >> np.uint64(64 - part_bits)).astype("i4")
    order = np.argsort(part, kind="stable")
    parts, starts = np.unique(part[order], return_index=True)
    offsets = pa.array(np.r_[starts, len(part)], pa.int32())
    names = ["lang", "phrase", "n", "f"]
    lists = [pa.ListArray.from_arrays(offsets, table[c].take(pa.array(order)).combine_chunks()) for c in names]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *lists], ["part", *names])


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, threshold: int = 100, most: int = 2000, covered: int = 100, text: str = "text", lang: str = "lang", longest: int = LONGEST
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language.

    a, l, r are the occurrences of the phrase and of the two parts of its weakest cut, n the words of the language,
    score floor(1000 * a * n / (l * r)) in decimals of 38 digits. Phrases that lie inside a longer candidate with at least
    ``covered`` percent of their occurrences are dropped. Order: score and a descending, then the phrase by its bytes. Null texts are empty, a null
    language is ``und`` (as is a language of that name), repeated rows count again, a very long text is a block of its own, an empty table gives
    no rows; other columns are not read.
    """
    found = stored(frequent(docs, threshold, text, lang, longest), "phrases")
    mass = found.where("n = 0").select("lang", F.col("f").alias("n"))
    grams = found.where("n > 0").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"))
    part = grams.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    words = F.split("phrase", " ", -1)
    phrases = grams.where("size > 1").withColumn("words", words)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part(F.col("words"), F.lit(1), F.col("k")).alias("left"), _part(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = spread_join(cuts, part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = spread_join(cuts, part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = spread_join(cuts, mass, ["lang"])
    exact = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    over = (exact[0] * exact[1]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    under = exact[2] * exact[3]
    cuts = cuts.withColumn("over", over.cast("decimal(38,0)")).withColumn("under", under.cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    inner = phrases.where("size > 2").withColumn("len", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("len") + 1)))
    inner = inner.groupBy("lang", _part(F.col("words"), F.col("at"), F.col("len")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    ranked = top_n(left, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

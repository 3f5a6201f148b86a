"""Alignment of two tokenizers' tokens on the bytes of each text, as an Arrow pipeline.

A text, with a space before it, is a row of parts that neither tokenizer joins: its words, each with the space before it (see ``remembered``), or, where
white space stands otherwise, the whole text. Every distinct part of a block of texts is encoded by both tokenizers and aligned once:
lists of ids are flattened with their parents, byte lengths are summed up inside each part, and an Acero hash join on
(part, end) finds where tokens of both end. Links (overlapping tokens) are counted by Table.group_by for each task, and Spark adds the
counts of all tasks up. The counts go back to the tasks' blocks, whose texts only keep numbers of parts, and become sums per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import sentencepieces
from skein.llm.common import stored
from skein.llm.remembered import Words, slices, threads

#: Bytes of text per block, and per set of counts.
BLOCK = 1 << 22
COUNTED = 1 << 26
#: Bits of the second tokenizer's ids in the number of a pair of ids.
BITS = 20


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Side:
    """A tokenizer: its encoder of parts, and of every id the bytes, their number, and the id in decimals."""

    words: Words
    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray
    names: pa.Array


def side(words: Words, raw: list[bytes]) -> Side:
    size = np.array([len(x) for x in raw], dtype="i8")
    return Side(words, np.frombuffer(b"".join(raw), "u1"), np.cumsum(size) - size, size, pa.array([str(i) for i in range(len(raw))]))


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """A byte-level tokenizer of the tokenizers library; it gets the space before the text, and special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    names = [n for n, _ in sorted(tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])]
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    table = _byte_of()
    raw = [bytes(table[c] for c in n) if all(c in table for c in n) else n.encode() for n in names]
    starts = np.array([n.startswith("Ġ") for n in names])
    tails = {c: np.array(encode([c])[0], "<u4").tobytes() for c in ".,"}
    return side(Words(lambda texts: encode([" " + t for t in texts]), starts, "<u4", " ", True, tails=tails, most=60_000), raw)


@lru_cache(maxsize=2)
def piece_side(form: str) -> Side:
    """A SentencePiece model that puts the space itself, rebuilt on the tokenizers library."""
    codec = sentencepieces.codec(form, None)
    if codec.words is None:
        raise ValueError("the second tokenizer must put a space before texts and keep them as they are")
    return side(Words(codec._raw, codec.words.starts, "<u4", sentencepieces.MARK, True, most=60_000), codec.raw)


@dataclass
class Parts:
    """Distinct parts of a block with the ids of both sides as lists, and for every text its parts by number."""

    ids: tuple[pa.ListArray, pa.ListArray]
    raw: list[bytes]
    sequence: np.ndarray
    sizes: np.ndarray


def parts_of(texts: pa.Array, sides: tuple[Side, Side]) -> Parts:
    """Texts (not null, not empty) as rows of parts."""
    split = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(split.flatten())
    offsets = np.asarray(split.offsets, dtype="i8")
    offsets = offsets - offsets[0]
    words, number = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype("i8")
    found = [s.words.of(words) for s in sides]
    cut = np.array([a is not None and b is not None for a, b in zip(*found)])
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = np.zeros(len(texts), dtype=bool)
    whole[owner[~cut[number]]] = True
    entire = texts.filter(pa.array(whole)).to_pylist()
    lists = []
    for s, known in zip(sides, found):
        more = [np.array(ids, "<u4").tobytes() for ids in s.words.encode(entire)] if entire else []
        kept = [x or b"" for x in known] + more
        sizes = np.array([len(x) // 4 for x in kept], dtype="i8")
        flat = np.frombuffer(b"".join(kept), "<u4")
        lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat.astype("i4"), pa.int32())))
    place = np.where(whole, np.cumsum(whole) - 1 + len(words), -1)
    keep = ~whole[owner] | np.r_[True, owner[1:] != owner[:-1]]
    sequence = np.where(whole[owner], place[owner], number)[keep]
    return Parts((lists[0], lists[1]), [(" " + w).encode() for w in [*words, *entire]], sequence, np.where(whole, 1, counts))


def _ends(ids: pa.ListArray, s: Side) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Flattened ids, the part of each, and the byte where it ends in its part: a sum over the block, less the sum at the part's start."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    size = pc.take(pa.array(s.size), flat)
    total = pc.cumulative_sum(size)
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), ids.offsets[:-1])
    return np.asarray(flat), parent, size, pc.subtract(total, pc.take(before, parent))


def same_bytes(ids: pa.ListArray, s: Side, raw: list[bytes]) -> np.ndarray:
    """Whether the bytes of each part's tokens are the part's."""
    flat, parent, size, _ = _ends(ids, s)
    size, parent = np.asarray(size), np.asarray(parent)
    long = np.bincount(parent, size, len(raw)).astype("i8")
    fits = long == np.array([len(x) for x in raw])
    keep = fits[parent]
    flat, size, owner = flat[keep], size[keep], parent[keep]
    made = s.flat[np.repeat(s.start[flat], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
    want = np.frombuffer(b"".join(x for x, fit in zip(raw, fits) if fit), "u1")
    fits[np.repeat(owner, size)[made != want]] = False
    return fits


@dataclass
class Aligned:
    """Per part: whether both sides keep its bytes, numbers of tokens and groups, groups as text, and the pairs of ids linked (flat, with offsets)."""

    fine: np.ndarray
    n: tuple[np.ndarray, np.ndarray]
    n_groups: np.ndarray
    groups: pa.Array
    pairs: np.ndarray
    offsets: np.ndarray


def align(parts: Parts, sides: tuple[Side, Side]) -> Aligned:
    fine = same_bytes(parts.ids[0], sides[0], parts.raw) & same_bytes(parts.ids[1], sides[1], parts.raw)
    lists = parts.ids
    if not fine.all():
        kept = pa.array(fine)
        none = pa.array([[]], lists[0].type)[0]
        lists = tuple(pc.if_else(kept, x, none) for x in lists)
    keys, flats, begins, tables = [], [], [], []
    for name, ids, s in zip("ab", lists, sides):
        flat, parent, size, end = _ends(ids, s)
        key = pc.add(pc.shift_left(parent, pa.scalar(32, pa.int64())), end)
        keys.append(key)
        flats.append(flat)
        begins.append(np.asarray(pc.subtract(key, size)))
        tables.append(pa.table({"key": key, name: pa.array(np.arange(len(flat)), pa.int64())}))
    common = tables[0].join(tables[1], "key", join_type="inner", use_threads=False).sort_by("key")
    owner = np.asarray(common["key"]) >> 32
    n_groups = np.bincount(owner, minlength=len(fine))
    texts = []
    for name, flat, s in zip("ab", flats, sides):
        bounds = np.r_[0, np.asarray(common[name]) + 1]
        texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pc.take(s.names, pa.array(flat))), ","))
    joined = pc.binary_join_element_wise(texts[0], texts[1], "|")
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_groups)], pa.int32()), joined), ";")
    # A new pair of overlapping tokens begins where a token of either side begins.
    at_b = np.searchsorted(begins[1], begins[0], side="right") - 1
    at_a = np.searchsorted(begins[0], begins[1], side="right") - 1
    new = begins[0][at_a] != begins[1] if len(begins[0]) else np.zeros(0, dtype=bool)
    a = np.r_[flats[0], flats[0][at_a[new]]].astype("i8")
    b = np.r_[flats[1][at_b], flats[1][new]].astype("i8")
    part = np.r_[begins[0], begins[1][new]] >> 32
    order = np.argsort(part, kind="stable")
    n = tuple(np.diff(np.asarray(x.offsets)) for x in lists)
    return Aligned(fine, n, n_groups, groups, (a << BITS | b)[order], np.r_[0, np.cumsum(np.bincount(part, minlength=len(fine)))])


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of neighbouring runs of values."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _counted(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def encoded(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Blocks of aligned texts and the pair counts of each ``task`` of blocks, as one stored table: rows of blocks have ``ids``, rows of counts ``pairs``."""
    sent = docs.sparkSession.sparkContext.broadcast(sentencepieces.rebuild(piece_path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} array<long>" for c in NUMBERS)
    shape = f"task long, ids array<{kind}>, {counts}, groups_sha256 array<string>, sizes binary, sequence binary, widths binary, pairs binary, found array<long>, n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threads(False)
        sides = byte_side(byte_path), piece_side(sent.value)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        task, seen, tables = TaskContext.get().partitionId() << 32, 0, []
        schema = None
        for batch in batches:
            schema = schema or _schema(batch.column(0).type)
            at = 0
            for texts in slices(batch.column(1), BLOCK):
                ids = batch.column(0)[at : at + len(texts)]
                at += len(texts)
                some = np.asarray(pc.greater(pc.binary_length(texts), 0)).copy()
                if not some.any():
                    yield _block_row(task, ids, {c: [0] * len(ids) for c in NUMBERS}, [""] * len(ids), [squeeze(np.zeros(len(ids), "<u4").tobytes()), *[squeeze(b"")] * 3], schema)
                    continue
                parts = parts_of(texts.filter(pa.array(some)), sides)
                found = align(parts, sides)
                fine = _sums(~found.fine[parts.sequence], parts.sizes) == 0
                sequence, sizes = parts.sequence[np.repeat(fine, parts.sizes)], parts.sizes[fine]
                use = np.bincount(sequence, minlength=len(found.fine))
                links = np.diff(found.offsets)
                tables.append(pa.table({"pair": found.pairs, "n": np.repeat(use, links)}).filter(pc.greater(pc.field("n"), 0)))
                tables = [_counted(tables)]
                rows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pc.take(found.groups, pa.array(sequence)))
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(rows, ";")]
                some[some] = fine
                numbers = {}
                for name, per in zip(NUMBERS, (*found.n, found.n_groups, links)):
                    numbers[name] = np.zeros(len(texts), dtype="i8")
                    numbers[name][some] = _sums(per[sequence], sizes)
                hashes = np.full(len(texts), "", dtype=object)
                hashes[some] = digests
                wide = np.zeros(len(texts), dtype="<u4")
                wide[some] = sizes
                cells = [wide, sequence.astype("<u4"), links.astype("<u4"), found.pairs.astype("<u8")]
                yield _block_row(task, ids, {c: v.tolist() for c, v in numbers.items()}, hashes.tolist(), [squeeze(x.tobytes()) for x in cells], schema)
                del parts, found, rows, digests, cells
                pa.default_memory_pool().release_unused()
                seen += texts.nbytes
                if seen > COUNTED:
                    yield _counts_row(task, tables[0], schema)
                    task, seen, tables = task + 1, 0, []
        for s in sides:
            s.words.forget()
        if tables:
            yield _counts_row(task, tables[0], schema)

    return stored(docs.select("doc_id", "text").mapInArrow(run, shape), "aligned")


def _schema(kind: pa.DataType) -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([
        ("task", pa.int64()), ("ids", pa.list_(kind)), *[(c, longs) for c in NUMBERS], ("groups_sha256", pa.list_(pa.string())),
        *[(c, pa.binary()) for c in ("sizes", "sequence", "widths", "pairs")], ("found", longs), ("n", longs),
    ])


def _block_row(task: int, ids: pa.Array, numbers: dict[str, list[int]], hashes: list[str], cells: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    named = dict(zip(("sizes", "sequence", "widths", "pairs"), cells))
    return pa.RecordBatch.from_pylist([{"task": task, "ids": ids.to_pylist(), **numbers, "groups_sha256": hashes, **named, "found": None, "n": None}], schema)


def _counts_row(task: int, table: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    row = {c: None for c in schema.names} | {"task": task, "found": table["pair"].to_pylist(), "n": table["n"].to_pylist()}
    return pa.RecordBatch.from_pylist([row], schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus that hold both), best (whether no other count of this b is higher)."""
    pairs = blocks.where("found is not null").select(F.explode(F.arrays_zip("found", "n")).alias("x")).select(F.col("x.found").alias("pair"), F.col("x.n").alias("n"))
    total = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    total = total.select(F.shiftright("pair", BITS).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << BITS) - 1).cast("int").alias("b"), "count")
    highest = total.groupBy("b").agg(F.max("count").alias("high"))
    return total.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("high")).alias("best"))


def align_texts(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    A is the byte-level tokenizer, B the SentencePiece model. A group ends where tokens of both end; links are the overlapping pairs of tokens; ``count_sum`` adds up the corpus
    counts of each link's pair of ids, ``n_best`` counts the links whose pair is the most frequent of its B id (ties included). Texts that
    are null, empty or not kept byte for byte by both have zeros and ''. Whole texts, repeated rows again, null ids as they are; an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = encoded(rows, byte_path, piece_path)
    counts = stored(pair_counts(blocks), "pair-counts").select((F.shiftleft(F.col("a").cast("long"), BITS) + F.col("b")).alias("pair"), "count", "best")
    wanted = blocks.where("found is not null").select("task", F.explode("found").alias("pair")).join(counts, "pair")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pair")
        cells = {c: [np.asarray(table[c]).astype(t).tobytes()] for c, t in (("pair", "<u8"), ("count", "<i8"), ("best", "u1"))}
        return pa.table({"task": table["task"][:1], **{f"all_{c}": pa.array(v, pa.binary()) for c, v in cells.items()}})

    by_task = wanted.select("task", "pair", "count", "best").groupBy("task").applyInArrow(pack, "task long, all_pair binary, all_count binary, all_best binary")
    joined = blocks.where("ids is not null").drop("found", "n").join(by_task, "task", "left")
    names = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                sizes, sequence, widths = (np.frombuffer(expand(row[c].as_py()), "<u4").astype("i8") for c in ("sizes", "sequence", "widths"))
                pairs = np.frombuffer(expand(row["pairs"].as_py()), "<u8")
                known, count, best = (np.frombuffer(row[f"all_{c}"].as_py() or b"", t) for c, t in (("pair", "<u8"), ("count", "<i8"), ("best", "u1")))
                # Parts of texts that were left out have pairs without a count; no text uses them.
                place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                hit = known[place] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
                of = lambda values: _sums(_sums(np.where(hit, values[place], 0) if len(known) else np.zeros(len(pairs), "i8"), widths)[sequence], sizes)
                lists = [row[c].values for c in ("ids", *NUMBERS)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(of(best.astype("i8"))), pa.array(of(count)), row["groups_sha256"].values], names)

    longs = ", ".join(f"{c} long" for c in names[1:-1])
    return joined.mapInArrow(finish, f"doc_id {kind}, {longs}, groups_sha256 string")

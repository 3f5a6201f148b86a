"""Token files: ids ranked by frequency, in byte-aligned variable length with separate control bytes.

Texts are encoded once, with the corpus's counts of every id kept beside them. The id met most often gets
number 0, the next 1, and so on, so frequent ids take one byte. Four numbers share a control byte with
two bits each: the number's bytes less one. Control bytes and data bytes stand apart, so a
reader finds the length of all numbers by table lookup, without going through the data.

A token file is a Parquet table of blocks in ascending order of document id, one
row per block: its place (``bucket``, ``block``), ``start`` (ids before it in the corpus), and the parts of the format, all
little-endian: ``ids`` (64-bit), ``nulls`` (one byte per document), ``lengths`` (32-bit), ``control``, ``data``. Parquet gives splitting,
atomic commits and any storage that Spark reaches. The ranking is a table of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import bucket_of, id_bounds, stored
from skein.llm.remembered import Words, slices, threads
from skein.session import work_folder

BLOCK = "bucket int, block int, start long, ids binary, nulls binary, lengths binary, control binary, data binary"
BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), *[(n, pa.binary()) for n in ("ids", "nulls", "lengths", "control", "data")]])

#: For each control byte: bytes of each of its four numbers, where each begins, and all together.
SIZES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
PLACES = np.cumsum(SIZES, axis=1) - SIZES
TOTALS = SIZES.sum(1)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2 ** 32."""
    numbers = numbers.astype("<u4")
    extra = (numbers > 0xFF).astype("u1") + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    padded = np.zeros(-(-len(numbers) // 4) * 4, dtype="u1")
    padded[: len(numbers)] = extra
    control = (padded.reshape(-1, 4) << np.arange(0, 8, 2, dtype="u1")).sum(1, dtype="u1")
    kept = np.arange(4, dtype="u1") <= extra[:, None]
    return control.tobytes(), numbers.view("u1").reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of control and data bytes."""
    control = np.frombuffer(control, "u1")
    raw = np.concatenate([np.frombuffer(data, "u1"), np.zeros(16, "u1")])
    totals = TOTALS[control]
    at = ((np.cumsum(totals) - totals)[:, None] + PLACES[control]).ravel()[:n]
    sizes = SIZES[control].ravel()[:n]
    out = raw[at].astype("<u4")
    for byte in range(1, int(sizes.max(initial=1))):
        some = sizes > byte
        out[some] |= raw[at[some] + byte].astype("<u4") << np.uint32(8 * byte)
    return out


@lru_cache(maxsize=2)
def words(form: str) -> Words:
    """The byte-level tokenizer of a worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(form)
    names = [n for n, _ in sorted(tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])]
    starts = np.array([n.startswith("Ġ") for n in names])
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    dtype = "<u2" if len(names) <= 1 << 16 else "<u4"
    tails = {c: np.array(encode([c])[0], dtype).tobytes() for c in ".,"}
    return Words(encode, starts, dtype, " ", False, tails=tails)


def tokenize(docs: DataFrame, form: str, size: int, end: int) -> DataFrame:
    """The encoded texts (``counts`` null) and, for each task, its counts of ids (``doc_id`` null), as one stored table.

    Ids of a text, with the end id, are small unsigned integers, squeezed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(form)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threads(False)  # every core has its own task, and the texts sent are few
        coder = words(sent.value)
        tail = np.array([end], coder.dtype).tobytes()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        counts, id_type = np.zeros(size, "i8"), pa.int64()
        names = ["doc_id", "tie", "n", "ids", "counts"]
        for batch in batches:
            sizes, out, id_type = [], [], batch.column(0).type
            for part in slices(batch.column(2)):
                found, _ = coder.ids(part)
                sizes += [len(x) + 1 for x in found]
                out += [squeeze(x.tobytes() + tail) for x in found]
                counts += np.bincount(np.concatenate([*found, [end]]).astype("i8"), minlength=size)
                counts[end] += len(found) - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())], pa.array([squeeze(counts.tobytes())], pa.binary())], names)

    return stored(docs.select("doc_id", "tie", "text").mapInArrow(run, f"doc_id {kind}, tie long, n long, ids binary, counts binary"), "tokens")


def ranking(coded: DataFrame, size: int) -> np.ndarray:
    """All ids, most frequent first, equal counts in order of id. Counts are added up on the executors to at most 64 rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "i8")
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(zstandard.decompress(x), "i8")
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(total.tobytes())], pa.binary())], ["counts"])

    counts = coded.where("counts is not null").select("counts")
    rows = counts.mapInArrow(add, "counts binary").repartition(64).mapInArrow(add, "counts binary").collect()
    total = sum(np.frombuffer(zstandard.decompress(r["counts"]), "i8") for r in rows)
    return np.argsort(-total, kind="stable")


def write(coded: DataFrame, ranked: np.ndarray, folder: str, dtype: str, bucket_rows: int, most_buckets: int, block_ids: int) -> None:
    """Token file of the encoded texts in order of document id (nulls last, equal ids in order of a hash of the text)."""
    spark = coded.sparkSession
    texts = coded.where("ids is not null")
    bounds = id_bounds(texts.select("doc_id"), "doc_id", bucket_rows, most_buckets)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(bucket_of(F.col("doc_id"), bounds)[0]).cast("int")
    texts = texts.withColumn("bucket", bucket)
    order = Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket, so at most most_buckets + 1: few enough for one window and a broadcast.
    before = texts.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rank = np.empty(len(ranked), "<u4")
    rank[ranked] = np.arange(len(ranked), dtype="<u4")
    sent = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, block, start, waiting, held = sent.value, None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            ids = np.array([0 if i is None else i for i, _ in waiting], "<i8")
            nulls = bytes(i is None for i, _ in waiting)
            lengths = np.array([len(x) for _, x in waiting], "<u4")
            control, data = pack(number[np.concatenate([x for _, x in waiting])])
            row = {"bucket": own, "block": block, "start": start, "ids": ids.tobytes(), "nulls": nulls, "lengths": lengths.tobytes(), "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)

        for batch in batches:
            for bucket, doc_id, before, squeezed in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if waiting and (bucket != own or held >= block_ids):
                    yield out()
                    start, block, waiting, held = start + held, block + 1, [], 0
                if bucket != own:
                    own, block, start = bucket, 0, before
                ids = np.frombuffer(zstandard.decompress(squeezed), dtype)
                waiting.append((doc_id, ids))
                held += len(ids)
        if waiting:
            yield out()

    rows = texts.join(F.broadcast(before), "bucket").select("bucket", "doc_id", "before", "ids", "tie").repartition("bucket")
    rows.sortWithinPartitions(F.col("bucket"), F.col("doc_id").asc_nulls_last(), F.col("tie")).mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(folder)


def read(spark, folder: str, ranked: np.ndarray) -> DataFrame:
    """doc_id, start, ids (array<int>) of every document of a token file."""
    sent = spark.sparkContext.broadcast(ranked.astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, cuts, ids in _blocks(batches, sent.value):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype("i4")))], ["doc_id", "start", "ids"])

    return spark.read.schema(BLOCK).parquet(folder).mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(spark, folder: str, ranked: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a token file."""
    sent = spark.sparkContext.broadcast(ranked.astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, cuts, ids in _blocks(batches, sent.value):
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(BLOCK).parquet(folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _blocks(batches: Iterator[pa.RecordBatch], ranked: np.ndarray) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["lengths"], "<u4").astype("i8")
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            ids = ranked[unpack(row["control"], row["data"], int(cuts[-1]))]
            doc_ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], "?"))
            yield doc_ids, row["start"] + cuts[:-1], cuts, ids


def store(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end: int = 2, bucket_rows: int = 4000, most_buckets: int = 10_000, block_ids: int = 1 << 20) -> tuple[str, np.ndarray]:
    """Write a token file of every whole text and its ranking; gives the folder and the ranked ids.

    ``path`` is a file of the tokenizers library. A null text counts as empty and has the end id alone. Equal ids of documents
    follow each other in order of a hash of the text, null ids come last. An empty table gives an empty file.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("tie"))
    coded = tokenize(rows, tokenizer.to_str(), size, end)
    ranked = ranking(coded, size)
    folder = work_folder(docs.sparkSession, "token-file")
    write(coded, ranked, folder, "<u2" if size <= 1 << 16 else "<u4", bucket_rows, most_buckets, block_ids)
    return folder, ranked


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back from its token file."""
    folder, ranked = store(docs, path, **options)
    return digests(docs.sparkSession, folder, ranked)

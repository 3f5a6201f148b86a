"""Exact top-k by integer inner product: columnar branch and bound over blocks of vectors.

Vectors lie in blocks in vertical layout, one row of the block per dimension. A query adds up
the products of one block of dimensions after the other. By the Cauchy-Schwarz inequality the
rest of a product lies within |rest of the query| * |rest of the candidate|; candidates whose
best end lies below the k-th best worst end are dropped, and the columns of the others are
compacted before the next block of dimensions.

The stated query set meets all rows block by block: query blocks are sent to each candidate
block, every such pair keeps k rows per query, and a window picks the final k. Nothing but
one count reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored

#: Up to here sums of products of whole numbers in doubles are exact.
EXACT = 2.0**53
BLOCK = "slot long, dim int, ids binary, nulls binary, rows binary, cells binary"


def _pack(ids: np.ndarray, nulls: np.ndarray, rows: np.ndarray, cells: np.ndarray, slot: int) -> dict:
    return {"slot": slot, "dim": cells.shape[1], "ids": ids.tobytes(), "nulls": nulls.tobytes(), "rows": rows.tobytes(),
            "cells": np.ascontiguousarray(cells.T).tobytes()}


def _unpack(ids: bytes, nulls: bytes, rows: bytes, cells: bytes, dim: int) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(nulls, "?"), np.frombuffer(rows, "<i8"), np.frombuffer(cells, "<f8").reshape(dim, len(ids))


def _blocks(slots: int, block_rows: int):
    """Rows (id, vector) of a partition as blocks of at most block_rows; the last slot takes what is left over."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, waiting = TaskContext.get().partitionId(), 0, {}
        count: dict[int, int] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, nulls, rows, cells = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            n = count[dim] = count.get(dim, -1) + 1
            return pa.RecordBatch.from_pylist([_pack(ids, nulls, rows, cells, part * slots + min(n, slots - 1))], pa.schema(
                [("slot", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("rows", pa.binary()), ("cells", pa.binary())]))

        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            flat = np.floor(64.0 * np.asarray(vectors.flatten(), dtype="f8"))
            sizes = np.asarray(vectors.value_lengths())
            starts = np.cumsum(sizes) - sizes
            rows = (np.int64(part) << 40) + seen + np.arange(len(sizes))
            seen += len(sizes)
            nulls, keys = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0), dtype="<i8")
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                cells = flat[starts[own][:, None] + np.arange(dim)].reshape(len(own), dim)
                for at in range(0, len(own), block_rows):
                    cut = slice(at, at + block_rows)
                    waiting.setdefault(dim, []).append((keys[own[cut]], nulls[own[cut]], rows[own[cut]], cells[cut]))
                    if sum(len(x[0]) for x in waiting[dim]) >= block_rows:
                        yield out(dim)
        for dim in list(waiting):
            yield out(dim)

    return pack


def _exact(query: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Inner products in Python's whole numbers, held within 64 bits."""
    whole = [sum(int(a) * int(b) for a, b in zip(query, column)) for column in cells.T]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in whole], dtype="<i8")


def best(query: np.ndarray, row: int, rows: np.ndarray, ids: np.ndarray, nulls: np.ndarray, cells: np.ndarray, rest: np.ndarray,
         own_rest: np.ndarray, first: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best columns of a block for one query.

    ``first`` has the sums over the first block of dimensions, ``rest[b]`` each column's
    length over the dimensions from block b on, ``own_rest`` the query's.
    """
    at = np.flatnonzero(rows != row)
    total = first[at]
    for b in range(1, len(own_rest)):
        if len(at) > k:
            reach = own_rest[b] * rest[b][at] * (1 + 1e-9) + 1e-6
            worst = np.partition(total - reach, len(at) - k)[len(at) - k]
            keep = total + reach >= worst
            at, total = at[keep], total[keep]
        dims = slice(b * step, (b + 1) * step)
        total = total + query[dims] @ cells[dims][:, at]
    if len(at) > k:
        keep = total >= np.partition(total, len(at) - k)[len(at) - k]
        at, total = at[keep], total[keep]
    order = np.lexsort((rows[at], ids[at], nulls[at], -total))[:k]
    return at[order], total[order].astype("<i8")


def _search(k: int, step: int):
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                dim = pair["dim"]
                ids, nulls, rows, cells = _unpack(pair["ids"], pair["nulls"], pair["rows"], pair["cells"], dim)
                q_ids, _, q_rows, queries = _unpack(pair["q_ids"], pair["q_nulls"], pair["q_rows"], pair["q_cells"], dim)
                found = []
                blocks = range(0, max(dim, 1), step)
                rest = [np.sqrt((cells[b:] ** 2).sum(0)) for b in blocks]
                safe = dim == 0 or dim * np.abs(cells).max() * np.abs(queries).max() < EXACT
                first = queries[:step].T @ cells[:step] if safe else None
                for j, (query, row) in enumerate(zip(queries.T, q_rows)):
                    if safe:
                        own = [np.sqrt((query[b:] ** 2).sum()) for b in blocks]
                        at, score = best(query, row, rows, ids, nulls, cells, rest, own, first[j], k, step)
                    else:
                        score = _exact(query, cells)
                        order = np.lexsort((rows, ids, nulls, -score.astype(object)))
                        at = order[rows[order] != row][:k]
                        score = score[at]
                    found.append((np.full(len(at), row), np.full(len(at), q_ids[j]), rows[at], ids[at], nulls[at], score))
                q_row, q_id, v_row, v_id, v_null, score = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_row), pa.array(q_id), pa.array(v_row), pa.array(v_id, mask=v_null), pa.array(score)], schema=schema)

    return search


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = 4096,
    query_rows: int = 1024,
    step: int = 16,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row that meets ``queries``.

    ``queries`` is a condition on ``vec_id``. Components become floor(64 x). Unusable vectors take no part; vectors of other
    lengths are not compared. Every row counts as itself, also where an id or a vector repeats:
    a repeated query gives its rows again. A null id is a candidate, last among equal scores, and no query.
    Scores beyond 64 bits stop at the limit. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("cells")).where(usable(F.col("cells")))
    n = rows.count()
    wanted = max(1, -(-n // block_rows))
    parts = min(wanted, 20_000)
    slots = -(-wanted // parts)
    # Dealt round robin, so that copies of one vector are spread like any other rows.
    blocks = stored(rows.repartition(parts).mapInArrow(_blocks(slots, block_rows), BLOCK), "topk-blocks")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "row", "vec_id", "cells"]
        for batch in batches:
            for x in batch.to_pylist():
                ids, nulls, own, cells = _unpack(x["ids"], x["nulls"], x["rows"], x["cells"], x["dim"])
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array(np.full(len(ids), x["dim"], dtype="i4")), "row": pa.array(own), "vec_id": pa.array(ids, mask=nulls),
                    "cells": pa.array([c.tobytes() for c in np.ascontiguousarray(cells.T)], pa.binary())}).select(names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            own, ids, cells = zip(*waiting.pop(dim))
            matrix = np.frombuffer(b"".join(cells), "<f8").reshape(len(own), dim).T
            return pa.RecordBatch.from_pylist([{
                "dim": dim, "q_ids": np.array(ids, "<i8").tobytes(), "q_nulls": bytes(len(own)), "q_rows": np.array(own, "<i8").tobytes(),
                "q_cells": np.ascontiguousarray(matrix).tobytes()}],
                pa.schema([("dim", pa.int32()), ("q_ids", pa.binary()), ("q_nulls", pa.binary()), ("q_rows", pa.binary()), ("q_cells", pa.binary())]))

        for batch in batches:
            for x in batch.to_pylist():
                waiting.setdefault(x["dim"], []).append((x["row"], x["vec_id"], x["cells"]))
                if len(waiting[x["dim"]]) >= query_rows:
                    yield out(x["dim"])
        for dim in list(waiting):
            yield out(dim)

    asked = blocks.mapInArrow(some, "dim int, row long, vec_id long, cells binary").where(F.col("vec_id").isNotNull() & queries)
    packed = asked.mapInArrow(gather, "dim int, q_ids binary, q_nulls binary, q_rows binary, q_cells binary")
    sent = packed.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts * slots - 1).cast("long"))))
    found = blocks.join(sent, ["slot", "dim"]).mapInArrow(
        _search(k, step), "query_row long, query_id long, vec_row long, vec_id long, score long"
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

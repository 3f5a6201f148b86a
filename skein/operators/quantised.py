"""V5: nearest neighbours from short codes: a residual per cell, quantised part by part, exact distances last.

A vector is kept as the number of its cell and one byte per part of its residual. A query reads the codes of the cells it
probes, and only its best candidates are read as vectors and compared exactly. The codes of
a cell lie together, in pieces of many cells; a piece keeps a query's best candidates of all its cells.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import top_n
from skein.operators.vectors import BLOCK, PAIRS, Nearest, Search, by_task, grid, packed, unpacked
from skein.sources.snapshots import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_CELLS = 4096
# Queries of a piece that are looked up at once, and queries of a block.
QUERIES = 64
QUERY_BLOCK = 512
# Decoded vectors that a query block sees at once; queries of a strip and codes of a slot at most, on average.
SHOWN = 4096
STRIP, SLOT = 16_384, 1 << 20
# Vectors of a piece of the index, on average, and sampled vectors per task of the fit.
PIECE = 65_536
FITTED = 4096


@dataclass
class Quantiser:
    """Centres of the cells and, per part of the residual, its code words. Size: cells and code words times dimension."""

    centers: np.ndarray
    books: list[np.ndarray]

    @property
    def bounds(self) -> list[int]:
        return [0, *np.cumsum([b.shape[1] for b in self.books]).tolist()]

    def far(self, points: np.ndarray) -> np.ndarray:
        """Squared distance to each centre, less the square of the point."""
        return (self.centers**2).sum(axis=1)[None, :] - 2.0 * (points @ self.centers.T)

    def codes(self, points: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest, at = points - self.centers[cells], self.bounds
        return np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(at, at[1:], self.books)], axis=1).astype(np.uint8)

    def decoded(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        return self.centers[cells] + np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1)[None, :] - 2.0 * (points @ book.T)).argmin(axis=1)


def _book(points: np.ndarray, codes: int, seed: int, steps: int = 15) -> np.ndarray:
    """Code words of one part by Lloyd's rounds; distinct points themselves if they are few enough."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= codes:
        return distinct
    book = distinct[np.random.default_rng(seed).choice(len(distinct), codes, replace=False)]
    for _ in range(steps):
        own = _nearest(points, book)
        n = np.bincount(own, minlength=codes)
        sums = np.stack([np.bincount(own, weights=x, minlength=codes) for x in points.T], axis=1)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def fit(vectors: DataFrame, cells: int | None = None, parts: int = 16, codes: int = 256, sample_rows: int = 65_536, seed: int = 42) -> Quantiser:
    """Learn cells and code words from at most ``sample_rows`` vectors, the first by a hash of the id.

    ``cells`` follows the rows (their square root, at most 4096) unless given. Vectors that are null take no part; an empty table
    raises ValueError. Each part is learnt in a task of its own; cells and code words alone come to the driver.
    """
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    total = rows.count()
    if not total:
        raise ValueError("no vectors to learn from")
    cells = cells or max(1, min(MOST_CELLS, round(math.sqrt(total))))
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
    tasks = -(-min(total, sample_rows) // FITTED)
    if tasks > 1:
        # The first rows arrive in one partition, and rounds over them would be one task's work.
        sample = sample.repartition(tasks, "id").sortWithinPartitions(F.xxhash64("id", F.lit(seed)), "id")
    sample = sample.persist()
    try:
        centers = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(sample.select(array_to_vector("embedding").alias("features"))).clusterCenters())
        at = np.linspace(0, centers.shape[1], min(parts, centers.shape[1]) + 1).round().astype(int).tolist()
        coarse = Quantiser(centers, [])

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                points = np.stack(batch["embedding"].to_numpy())
                rest = points - centers[coarse.far(points).argmin(axis=1)]
                for p, (a, b) in enumerate(zip(at, at[1:])):
                    yield pd.DataFrame({"part": p, "piece": list(rest[:, a:b])})

        def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            pieces = np.stack(group["piece"].to_numpy())
            pieces = pieces[np.lexsort(pieces.T)]
            return pd.DataFrame({"part": [key[0]], "book": [_book(pieces, codes, seed + key[0]).astype("<f8").tobytes()], "width": [pieces.shape[1]]})

        pieces = sample.mapInPandas(split, "part int, piece array<double>")
        books = pieces.groupBy("part").applyInPandas(learn, "part int, book binary, width int").orderBy("part").collect()
    finally:
        sample.unpersist()
    return Quantiser(centers, [np.frombuffer(r.book, "<f8").reshape(-1, r.width) for r in books])


def encoded(vectors: DataFrame, model: Quantiser, block: int = BLOCK) -> DataFrame:
    """Index rows (cell, ids, codes): every vector as its cell and a byte per part, packed where it is read. No shuffle."""
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def out(cell: int) -> pd.DataFrame:
            ids, codes = zip(*held.pop(cell))
            return pd.DataFrame({"cell": [cell], "ids": [np.concatenate(ids).astype("<i8").tobytes()], "codes": [np.concatenate(codes).tobytes()]})

        for batch in batches:
            points, ids = np.stack(batch["embedding"].to_numpy()), batch["id"].to_numpy()
            cells = model.far(points).argmin(axis=1)
            codes = model.codes(points, cells)
            for cell in np.unique(cells).tolist():
                own = cells == cell
                held.setdefault(cell, []).append((ids[own], codes[own]))
                if sum(len(i) for i, _ in held[cell]) >= block:
                    yield out(cell)
        for cell in list(held):
            yield out(cell)

    return rows.mapInPandas(run, "cell long, ids binary, codes binary")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index rows sorted by cell as pieces of ``PIECE`` vectors and more: cells, ids, codes of each."""
    def out(held: list) -> pd.DataFrame:
        cells = np.concatenate([np.full(len(r.ids) // 8, r.cell, "<i4") for r in held])
        return pd.DataFrame({"cells": [cells.tobytes()], "ids": [b"".join(r.ids for r in held)], "codes": [b"".join(r.codes for r in held)]})

    held, n = [], 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            held.append(r)
            n += len(r.ids) // 8
            if n >= PIECE:
                yield out(held)
                held, n = [], 0
    if held:
        yield out(held)


def _seen(model: Quantiser, probes: int, best: Nearest, cells: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
    """Shows a query block the decoded vectors of a piece, to each query those of the cells that it probes.

    The distance to a decoded vector is the sum of the table entries of its code words.
    """
    near = np.argsort(model.far(best.queries), axis=1, kind="stable")[:, :probes]
    probed = np.zeros((len(best.queries), len(model.centers)), bool)
    np.put_along_axis(probed, near, True, axis=1)
    for low in range(0, len(ids), SHOWN):
        own = slice(low, low + SHOWN)
        best.take(ids[own], points[own], probed[:, cells[own]])


def _candidates(model: Quantiser, probes: int, query_ids: np.ndarray, queries: np.ndarray, cells: np.ndarray, ids: np.ndarray, codes: np.ndarray, most: int) -> Iterator[pd.DataFrame]:
    """Best ``most`` vectors of a piece for each query, in the cells that it probes."""
    points = model.decoded(cells, codes)
    for start in range(0, len(queries), QUERIES):
        best = Nearest(query_ids[start : start + QUERIES], queries[start : start + QUERIES], most)
        _seen(model, probes, best, cells, ids, points)
        yield _rough(best)


def _rough(best: Nearest) -> pd.DataFrame:
    found = best.rows("rough")
    found["rough"] **= 2
    return found


def candidates(index: DataFrame, model: Quantiser, queries: DataFrame, most: int, probes: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Best ``most`` ids per query (query_id, embedding) by the distances of the codes in its nearest cells; half of the cells unless ``probes`` is given.

    The codes are shuffled once by cell and packed in pieces. Strips of queries meet slots of many pieces, each in a task that lets the pieces pass
    and keeps ``most`` rows per query, so what is shuffled grows with the queries and hardly with the pieces.
    """
    probes = probes or max(1, (len(model.centers) + 1) // 2)
    size = index.agg(F.sum(F.length("ids") / 8)).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, math.ceil(size / PIECE))
    pieces = stored(index.repartition(tasks, "cell").sortWithinPartitions("cell").mapInPandas(_pieces, "cells binary, ids binary, codes binary"), "code-pieces")
    asked = stored(packed(queries.withColumn("__one", F.lit(0)), "__one", "query_id", "q_", block).drop("key"), "query-blocks")
    blocks, rows = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("q_ids") / 8), F.lit(0))).first()
    slots = max(1, math.ceil(size / SLOT))
    strips = max(1, math.ceil(rows / STRIP), min(blocks, 2 * cores // slots))
    pieces = pieces.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots).cast("long")))
    asked = asked.withColumn("strip", F.pmod(F.xxhash64("q_ids"), F.lit(strips).cast("long")))

    def pass_by(held: list[Nearest], row) -> None:
        ids, cells = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.cells, "<i4")
        points = model.decoded(cells, np.frombuffer(row.codes, np.uint8).reshape(len(ids), -1))
        for best in held:
            _seen(model, probes, best, cells, ids, points)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return by_task(batches, lambda: Search(most, pass_by), lambda done: (_rough(best) for best in done.held))

    found = grid(pieces, asked, strips, slots).mapInPandas(look, "query_id long, id long, rough double")
    return top_n(found, ["query_id"], ["rough", "id"], most, "place")


class _Compared:
    """A task of a grid: its queries and vectors are held, lists of pairs of their ids pass and give the ``k`` nearest of each query."""

    def __init__(self, k: int) -> None:
        self.k, self.sides, self.sorted, self.found = k, ([], []), None, []

    def __call__(self, row) -> None:
        if row.kind < 2:
            self.sides[row.kind].append(unpacked(row.q_ids, row.q_cells) if row.kind == 0 else unpacked(row.ids, row.cells))
        elif all(self.sides):
            if self.sorted is None:
                self.sorted = [_by_id(side) for side in self.sides]
            asked, ids = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.cells, "<i8")
            for low in range(0, len(ids), PAIRS):
                self._compare(asked[low : low + PAIRS], ids[low : low + PAIRS])

    def _compare(self, asked: np.ndarray, ids: np.ndarray) -> None:
        (query_ids, queries), (point_ids, points) = self.sorted
        pair, q = _places(query_ids, asked)
        again, p = _places(point_ids, ids[pair])
        q = q[again]
        distance = np.sqrt(((points[p] - queries[q]) ** 2).sum(axis=1))
        order = np.lexsort((point_ids[p], distance, query_ids[q]))
        own, p, distance = query_ids[q][order], point_ids[p][order], distance[order]
        keep = np.arange(len(own)) - np.searchsorted(own, own) < self.k
        self.found.append(pd.DataFrame({"query_id": own[keep], "id": p[keep], "distance": distance[keep]}))


def _by_id(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = np.concatenate([i for i, _ in blocks]), np.concatenate([v for _, v in blocks])
    order = np.argsort(ids, kind="stable")
    return ids[order], vectors[order]


def _places(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An equi-join: numbers of wanted ids and places of the sorted ids that equal them."""
    low, high = np.searchsorted(ids, wanted, "left"), np.searchsorted(ids, wanted, "right")
    n = high - low
    number = np.repeat(np.arange(len(wanted)), n)
    return number, np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n) + low[number]


def reranked(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of the candidates by their true distances, ties by id.

    Pairs of ids travel as lists to the tasks where strips of queries meet slots of vectors, so no vector is sent for each pair that names it.
    """
    strips, slots = (max(1, math.ceil(side.count() / PIECE)) for side in (queries, vectors))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    strips = max(strips, math.ceil(cores / slots))
    part = lambda column, parts: F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(parts).cast("long"))
    points = packed(vectors.withColumn("__slot", part("id", slots)), "__slot", "id", "").select(F.col("key").alias("slot"), "ids", "cells")
    asked = packed(queries.withColumn("__strip", part("query_id", strips)), "__strip", "query_id", "q_").select(F.col("key").alias("strip"), "q_ids", "q_cells")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task, own in batch.groupby("task"):
                yield pd.DataFrame({"task": [task], "kind": [2], "ids": [own["query_id"].to_numpy("<i8").tobytes()], "cells": [own["id"].to_numpy("<i8").tobytes()]})

    task = (part("query_id", strips) * slots + part("id", slots)).cast("int").alias("task")
    pairs = found.where(F.col("query_id").isNotNull() & F.col("id").isNotNull()).select(task, F.col("query_id").cast("long"), F.col("id").cast("long"))
    lists = pairs.mapInPandas(listed, "task int, kind int, ids binary, cells binary")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return by_task(batches, lambda: _Compared(k), lambda done: iter(done.found))

    near = grid(points, asked, strips, slots, lists).mapInPandas(compare, "query_id long, id long, distance double")
    return top_n(near, ["query_id"], ["distance", "id"], k)

"""Vector search, clustering and embedding."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import top_n

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors or queries per packed block.
BLOCK = 2048
# Vectors and queries that a task meets at most, on average.
PIECE, STRIP = 65_536, 131_072
# Pairs whose differences are taken at once.
PAIRS = 100_000


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    """1 for the same point, towards 0 far away."""
    return 1.0 / (1.0 + distance)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """K1: nearest vectors of one query; each task keeps its k best before the merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return (
        vectors.select("id", l2_distance(F.col("embedding"), q).alias("distance"))
        .orderBy("distance", "id").limit(k).withColumn("similarity", similarity(F.col("distance")))
    )


def packed(rows: DataFrame, key: str, ident: str, prefix: str, block: int = BLOCK) -> DataFrame:
    """Rows (key, id, embedding) as blocks of at most ``block``, packed where they are read, without a shuffle: key, ids, cells, dimension.

    A task holds at most 64 blocks' worth of rows; beyond that its largest key goes out early.
    """
    plain = rows.where(F.col("embedding").isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(ident).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        n = 0

        def out(own: int) -> pd.DataFrame:
            ids, cells = held.pop(own)
            matrix = np.stack(cells)
            return pd.DataFrame({"key": [own], f"{prefix}ids": [np.array(ids, dtype="<i8").tobytes()], f"{prefix}cells": [matrix.tobytes()], f"{prefix}dim": [matrix.shape[1]]})

        for batch in batches:
            for k, i, e in zip(batch["key"], batch["id"], batch["embedding"]):
                ids, cells = held.setdefault(k, ([], []))
                ids.append(i)
                cells.append(np.asarray(e, dtype="<f8"))
                n += 1
                if len(ids) >= block:
                    n -= len(ids)
                    yield out(k)
                elif n >= 64 * block:
                    largest = max(held, key=lambda x: len(held[x][0]))
                    n -= len(held[largest][0])
                    yield out(largest)
        for own in list(held):
            yield out(own)

    return plain.mapInPandas(pack, f"key long, {prefix}ids binary, {prefix}cells binary, {prefix}dim int")


class Nearest:
    """The k nearest points of every query of a block, by distance then id, while blocks of points come."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.squares = (queries**2).sum(axis=1)
        # Squared distance of the k-th point so far.
        self.limit = np.full(len(ids), np.inf)
        self.q, self.p, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def take(self, ids: np.ndarray, points: np.ndarray, open_: np.ndarray | None = None) -> None:
        """A matrix product finds who can be among them, direct differences give their distances. ``open_`` says which points a query may see."""
        squares = (points**2).sum(axis=1)
        rough = self.queries @ (-2.0 * points.T)
        rough += squares
        rough += self.squares[:, None]
        if open_ is not None:
            rough[~open_] = np.inf
        limit = self.limit
        if np.isinf(limit).any():
            some = min(self.k, rough.shape[1])
            limit = np.fmin(limit, np.partition(rough, some - 1, axis=1)[:, some - 1])
        # Points with an unknown number are near to nothing.
        slack = 1e-6 + 1e-12 * (self.squares + squares[np.isfinite(squares)].max(initial=0))
        # Not even the largest number: what is infinite is not seen.
        near = np.flatnonzero(rough <= np.minimum(limit + slack, np.finfo(np.float64).max)[:, None])
        # Many copies of a point are as near as the k-th, so pairs are compared a portion at a time.
        for low in range(0, len(near), PAIRS):
            q, p = np.divmod(near[low : low + PAIRS], rough.shape[1])
            self._add(q, ids[p], np.sqrt(((points[p] - self.queries[q]) ** 2).sum(axis=1)))

    def _add(self, q: np.ndarray, p: np.ndarray, distance: np.ndarray) -> None:
        q, p, distance = np.r_[self.q, q], np.r_[self.p, p], np.r_[self.distance, distance]
        order = np.lexsort((p, distance, q))
        q, p, distance = q[order], p[order], distance[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.p, self.distance = q[keep], p[keep], distance[keep]
        last = place[keep] == self.k - 1
        self.limit[self.q[last]] = self.distance[last] ** 2

    def rows(self, distance: str = "distance") -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.q], "id": self.p, distance: self.distance})


def _best_of_block(ids: np.ndarray, queries: np.ndarray, point_ids: np.ndarray, points: np.ndarray, k: int) -> pd.DataFrame:
    best = Nearest(ids, queries, k)
    best.take(point_ids, points)
    return best.rows()


def _met(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best k of all pairs of packed blocks with one key."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, point_ids = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.ids, "<i8")
                yield _best_of_block(ids, np.frombuffer(r.q_cells, "<f8").reshape(len(ids), -1), point_ids, np.frombuffer(r.cells, "<f8").reshape(len(point_ids), -1), k)

    found = points.join(queries, "key").mapInPandas(search, "query_id long, id long, distance double")
    return top_n(found, ["query_id"], ["distance", "id"], k)


def unpacked(ids: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a packed block."""
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(cells, "<f8").reshape(len(found), -1)


def grid(points: DataFrame, queries: DataFrame, strips: int, slots: int, others: DataFrame | None = None) -> DataFrame:
    """Rows of ``points`` (slot, ...) and of ``queries`` (strip, q_ids, q_cells) in the tasks where every strip meets every slot, and ``others`` (task, kind, ...).

    A partition is a task, with its queries first (``kind`` 0), then its points (1), then the others.
    """
    sent = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))
    asked = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    task = (F.col("strip") * slots + F.col("slot")).cast("int").alias("task")
    rest = [c for c in points.columns if c != "slot"]
    rows = asked.select(task, F.lit(0).alias("kind"), "q_ids", "q_cells").unionByName(sent.select(task, F.lit(1).alias("kind"), *rest), allowMissingColumns=True)
    if others is not None:
        rows = rows.unionByName(others, allowMissingColumns=True)
    return rows.repartitionById(strips * slots, F.col("task")).sortWithinPartitions("task", "kind")


def by_task(batches: Iterator[pd.DataFrame], begin, end) -> Iterator[pd.DataFrame]:
    """Rows of a grid: ``begin`` makes the state of a task, called with each of its rows; ``end`` gives what the state found."""
    task, state = None, None
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.task != task:
                if state is not None:
                    yield from end(state)
                task, state = r.task, begin()
            state(r)
    if state is not None:
        yield from end(state)


class Search:
    """A task of a grid: its blocks of queries are held, blocks of points pass."""

    def __init__(self, k: int, pass_by) -> None:
        self.k, self.pass_by, self.held = k, pass_by, []

    def __call__(self, row) -> None:
        if row.kind == 0:
            self.held.append(Nearest(*unpacked(row.q_ids, row.q_cells), self.k))
        else:
            self.pass_by(self.held, row)


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, slots: int | None = None) -> DataFrame:
    """V1: exact nearest k vectors for each query (query_id, embedding), by distance then id.

    Vectors and queries are packed in blocks where they are read, and dealt to ``slots`` and strips, of about ``PIECE`` vectors and ``STRIP`` queries at
    most; every strip meets every slot in a task of its own, which holds the strip, lets the blocks of the slot pass and keeps k rows per query.
    Nothing passes the driver. The work is queries times vectors; what is sent is vectors times strips and queries times slots.
    """
    asked, n = queries.count(), vectors.count()
    # As many strips as slots if both sides are of one size, so that least is sent.
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    strips = max(1, math.ceil(asked / STRIP), min(math.ceil(asked / block), round(math.sqrt(tasks * asked / max(n, 1)))))
    if slots is None:
        slots = max(1, math.ceil(n / PIECE), min(math.ceil(n / block), math.ceil(tasks / strips)))
    points = packed(vectors.withColumn("__one", F.lit(0)), "__one", "id", "", block)
    points = points.select(F.pmod(F.xxhash64("ids"), F.lit(slots).cast("long")).alias("slot"), "ids", "cells")
    blocks = packed(queries.withColumn("__one", F.lit(0)), "__one", "query_id", "q_", block)
    blocks = blocks.select(F.pmod(F.xxhash64("q_ids"), F.lit(strips).cast("long")).alias("strip"), "q_ids", "q_cells")

    def pass_by(held: list[Nearest], row) -> None:
        for best in held:
            best.take(*unpacked(row.ids, row.cells))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return by_task(batches, lambda: Search(k, pass_by), lambda done: (best.rows() for best in done.held))

    found = grid(points, blocks, strips, slots).mapInPandas(search, "query_id long, id long, distance double")
    return top_n(found, ["query_id"], ["distance", "id"], k)


def search_assets(vectors: DataFrame, identity: DataFrame, queries: DataFrame, k: int, asset_types: list[str]) -> DataFrame:
    """Nearest identified assets; nothing unless skills are asked for."""
    wanted = F.lit("skill" in asset_types)
    known = vectors.where(wanted).join(identity.select("id"), "id", "left_semi")
    return knn(known, queries, k).join(identity, "id").withColumn("similarity", similarity(F.col("distance")))


def with_metadata(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """J4."""
    return vectors.join(metadata, "id")


def identified_vectors(vectors: DataFrame, metadata: DataFrame, index_state: DataFrame) -> DataFrame:
    """Vectors whose source has an index state."""
    return vectors.join(metadata, "id").join(index_state, "source_path")


def find_similar(vectors: DataFrame, names: DataFrame, name: str, k: int) -> DataFrame:
    """V3: neighbours of a document by name, without itself; empty for an unknown name."""
    target = names.where(F.lower("name") == name.lower()).orderBy("name", "id").limit(1)
    query = vectors.join(target.select("id"), "id").select(F.col("id").alias("query_id"), "embedding")
    return knn(vectors, query, k + 1).where(F.col("id") != F.col("query_id")).where(F.col("rank") <= k + 1).orderBy("distance", "id").limit(k)


def similar_for_all(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """V3 for a set of queries: k neighbours without itself."""
    others = knn(vectors, queries, k + 1).where(F.col("id") != F.col("query_id")).drop("rank")
    return top_n(others, ["query_id"], ["distance", "id"], k)


def clusters(vectors: DataFrame, k: int, dimension: int, seed: int = 42, restarts: int = 10) -> tuple[DataFrame, float]:
    """V4: best of several k-means runs; a missing vector counts as zeros."""
    zeros = F.array_repeat(F.lit(0.0), dimension)
    points = vectors.select("id", array_to_vector(F.coalesce(F.col("embedding").cast("array<double>"), zeros)).alias("features")).persist()
    best = None
    try:
        parts = min(k, points.count())
        for step in range(restarts):
            model = KMeans(k=parts, seed=seed + step, featuresCol="features", predictionCol="cluster").fit(points)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
        cost = float(best.summary.trainingCost)
    finally:
        points.unpersist()
    return best.transform(points).select("id", F.col("cluster").cast("long").alias("cluster")), cost


def approximate_knn(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 64, probes: int = 32, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """V5: neighbours among the vectors of the nearest cells of a k-means partition.

    Half of the cells are probed by default, as vectors without clusters need for a recall of 0.9
    (measured: 0.93 to 0.96; 8 cells give 0.63 to 0.70). Vectors and queries meet in a join on the cell, in packed blocks, so a crowded cell is many pairs of
    blocks in many tasks and never pairs of its members.
    """
    features = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    centers = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(features).clusterCenters())

    @F.pandas_udf("array<long>")
    def nearest_cells(found: pd.Series) -> pd.Series:
        points = np.stack(found.to_numpy()).astype(np.float64)
        far = (centers**2).sum(axis=1)[None, :] - 2.0 * (points @ centers.T)
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes]))

    points = vectors.select("id", "embedding", nearest_cells("embedding")[0].alias("cell"))
    asked = queries.select("query_id", "embedding", F.explode(nearest_cells("embedding")).alias("cell"))
    return _met(packed(points, "cell", "id", "", block), packed(asked, "cell", "query_id", "q_", block), k)


def embed_texts(documents: DataFrame, tokens: Column, dimension: int = 256) -> DataFrame:
    """Unit TF-IDF vectors by feature hashing, for documents and queries alike."""
    words = documents.select("id", tokens.alias("tokens"))
    counted = HashingTF(numFeatures=dimension, inputCol="tokens", outputCol="tf").transform(words).persist()
    weighted = IDF(inputCol="tf", outputCol="weighted").fit(counted).transform(counted)
    counted.unpersist()
    unit = Normalizer(inputCol="weighted", outputCol="unit").transform(weighted)
    return unit.select("id", vector_to_array("unit", "float32").alias("embedding"))


def embed_with(documents: DataFrame, embed, dimension: int) -> DataFrame:
    """Vectors from a caller's function over batches of texts: list of str to (n, dimension)."""
    def run(batches):
        for batch in batches:
            vectors = np.asarray(embed(batch["text"].tolist()), dtype=np.float32)
            if vectors.shape != (len(batch), dimension):
                raise ValueError(f"expected {(len(batch), dimension)}, got {vectors.shape}")
            yield pd.DataFrame({"id": batch["id"], "embedding": list(vectors)})

    return documents.select("id", "text").mapInPandas(run, "id long, embedding array<float>")

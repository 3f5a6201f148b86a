"""Lexical ranking, rank fusion and retrieval quality."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.search import search_tokens
from skein.operators.skew import spread_join, top_n
from skein.sources.snapshots import stored

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
FUSION = 60


def postings(documents: DataFrame, weights: dict[str, float]) -> DataFrame:
    """V6: index rows (id, length, term, wtf, n): tokens of the document, weighted and plain term frequency."""
    return index_rows(indexed(documents, weights))


def indexed(documents: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The index as one row per id: its entries (term, length, wtf, n); ids without a token have none.

    One shuffle, of the documents by id: words are counted where their document lies. Rows of one id and length count as one document.
    """
    placed = documents.select("id", *weights).repartition("id").sortWithinPartitions("id")
    arrays = placed.select("id", *[search_tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in weights])
    kind = documents.schema["id"].dataType.simpleString()
    own = [float(w) for w in weights.values()]
    return arrays.mapInArrow(lambda batches: _entries(batches, own), f"id {kind}, {ENTRIES}")


ENTRIES = "entries array<struct<term:string,length:int,wtf:double,n:bigint>>"
#: Tokens counted at once, but for an id that has more.
COUNTED = 500_000


def _entries(batches: Iterator[pa.RecordBatch], weights: list[float]) -> Iterator[pa.RecordBatch]:
    """Counted tokens of rows sorted by id, never cut within an id."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.concat_batches([held, batch])
        new = _starts(batch.column(0))
        held = batch.slice(int(new[-1]))
        yield from _counted(batch.slice(0, int(new[-1])), weights)
    if held is not None:
        yield from _counted(held, weights)


def _starts(ids: pa.Array) -> np.ndarray:
    """Rows whose id is not the one before."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _counted(rows: pa.RecordBatch, weights: list[float]) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    lengths = sum(pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in rows.columns[1:])
    new = _starts(rows.column(0))
    for low, high in _pieces(np.add.reduceat(lengths, new), rows.num_rows, COUNTED):
        first, last = int(new[low]), int(new[high]) if high < len(new) else rows.num_rows
        part, length = rows.slice(first, last - first), lengths[first:last]
        own = np.repeat(np.arange(high - low), np.diff(np.r_[new[low:high], last]))
        keys, key = np.unique(np.stack([own, length]), axis=1, return_inverse=True)
        sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in part.columns[1:]]
        tokens = pa.table({
            "key": np.concatenate([np.repeat(key.ravel(), n) for n in sizes]),
            "term": pa.chunked_array([c.flatten() for c in part.columns[1:]]),
            "w": np.concatenate([np.full(int(n.sum()), w) for n, w in zip(sizes, weights)])})
        found = tokens.group_by(["key", "term"], use_threads=False).aggregate([("w", "sum"), ("w", "count")])
        found = found.sort_by("key").combine_chunks()
        if not found.num_rows:
            continue
        owner, of_key = keys[:, found["key"].to_numpy()]
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        entries = pa.StructArray.from_arrays(
            [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (found["term"], pa.array(of_key.astype(np.int32)), found["w_sum"], found["w_count"])],
            names=["term", "length", "wtf", "n"])
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(new[low:high][owner[cuts]])), pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(owner)].astype(np.int32)), entries)],
            names=["id", "entries"])


def by_document(index: DataFrame) -> DataFrame:
    """Index rows as one row per id."""
    return index.groupBy("id").agg(F.collect_list(F.struct("term", "length", "wtf", "n")).alias("entries"))


def index_rows(entries: DataFrame) -> DataFrame:
    """The rows of ``indexed``."""
    return entries.select("id", F.inline("entries")).select("id", "length", "term", "wtf", "n")


def bm25(index: DataFrame, documents: int | Column, queries: DataFrame, k: int) -> DataFrame:
    """V6: best k documents per query (query_id, text); any word matches, ties go by id.

    ``index`` holds stored ``postings``; ``documents`` is their number.
    """
    return ranked(by_document(index), documents, queries, k)


def ranked(entries: DataFrame, documents: int | Column, queries: DataFrame, k: int) -> DataFrame:
    """``bm25`` over stored rows of ``indexed``.

    Documents are packed in blocks where they are read, queries in blocks of their words; each pair of blocks is scored by matrices
    in one task and keeps k rows per query, so no score is shuffled. Spark broadcasts the query blocks if their files are small
    enough, and pairs partitions if not.
    """
    words = queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("qtf"))
    n = F.lit(documents)
    terms = entries.select(F.explode("entries").alias("e")).groupBy("e.term").agg(F.count(F.lit(1)).alias("df"), F.sum("e.n").alias("n"))
    terms = stored(terms, "term-counts")
    mean = terms.agg(F.sum("n")).scalar() / n
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    known = words.join(terms.select("term", "df"), "term").select("query_id", F.struct(F.xxhash64("term").alias("word"), (F.col("qtf") * idf).alias("weight")).alias("word"))
    asked = known.groupBy("query_id").agg(F.collect_list("word").alias("words")).select("query_id", "words.word", "words.weight", mean.alias("mean"))
    kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((entries, "id"), (queries, "query_id")))
    asked = stored(asked.mapInArrow(_query_blocks, f"queries array<{query_kind}>, q_sizes binary, q_words binary, weights binary, mean double"), "query-blocks")
    each = entries.select("id", F.transform("entries", lambda e: F.xxhash64(e["term"])).alias("word"), F.col("entries.wtf").alias("wtf"), F.col("entries.length").cast("array<long>").alias("length"))
    blocks = each.mapInArrow(_document_blocks, f"ids array<{kind}>, sizes binary, words binary, wtf binary, lengths binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _scored(batch.slice(i, 1), k)

    found = blocks.crossJoin(asked).mapInArrow(score, f"query_id {query_kind}, id {kind}, score double")
    return top_n(found, ["query_id"], [F.desc(F.round("score", 6)), "id"], k)


#: Most documents and postings of a block (one document may have more), queries of a block, and words scored at once.
BLOCK_DOCUMENTS = 512
BLOCK_POSTINGS = 200_000
BLOCK_QUERIES = 256
STRIP = 1024


def _pieces(sizes: np.ndarray, rows: int, entries: int) -> Iterator[tuple[int, int]]:
    """Runs of at most so many rows with at most so many entries, or of one row."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        before = ends[low] - sizes[low]
        high = min(low + rows, max(low + 1, int(np.searchsorted(ends, before + entries, "right"))))
        yield low, high
        low = high


def _packed(batches: Iterator[pa.RecordBatch], names: Sequence[str], rows: int, entries: int, constant: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (id, lists of numbers) as blocks: ids, sizes of the lists, and each list's numbers as bytes."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype("<i4")
        for low, high in _pieces(sizes, rows, entries):
            part = batch.slice(low, high - low)
            lists = [part.column(c).flatten().to_numpy(zero_copy_only=False).tobytes() for c in range(1, part.num_columns - (constant is not None))]
            ids = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), part.column(0))
            arrays = [ids, *[pa.array([x], pa.binary()) for x in (sizes[low:high].tobytes(), *lists)]]
            if constant is not None:
                arrays.append(part.column(part.num_columns - 1).slice(0, 1))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *([constant] if constant is not None else [])])


def _document_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _packed(batches, ["ids", "sizes", "words", "wtf", "lengths"], BLOCK_DOCUMENTS, BLOCK_POSTINGS)


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _packed(batches, ["queries", "q_sizes", "q_words", "weights"], BLOCK_QUERIES, BLOCK_POSTINGS, "mean")


def _scored(pair: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Best k documents of a block for each query of a block."""
    def numbers(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(pair.column(name)[0].as_buffer(), kind)

    ids, queries = pair.column("ids").flatten(), pair.column("queries").flatten()
    sizes, query_sizes = numbers("sizes", "<i4"), numbers("q_sizes", "<i4")
    vocabulary, asked = np.unique(numbers("q_words", "<i8"), return_inverse=True)
    asking = np.repeat(np.arange(len(query_sizes)), query_sizes)
    words = numbers("words", "<i8")
    place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    known = vocabulary[place] == words
    row, place = np.repeat(np.arange(len(sizes)), sizes)[known], place[known]
    wtf, length = numbers("wtf", "<f8")[known], numbers("lengths", "<i8")[known]
    part = wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * length / pair.column("mean")[0].as_py()))
    weights = numbers("weights", "<f8")
    scores = np.zeros((len(sizes), len(query_sizes)))
    for low in range(0, len(vocabulary), STRIP):
        here, there = (place >= low) & (place < low + STRIP), (asked >= low) & (asked < low + STRIP)
        left = np.bincount(row[here] * STRIP + place[here] - low, part[here], len(sizes) * STRIP).reshape(-1, STRIP)
        right = np.bincount((asked[there] - low) * len(query_sizes) + asking[there], weights[there], STRIP * len(query_sizes)).reshape(STRIP, -1)
        scores += left @ right
    # Ties by id, so the documents are taken in its order; a score of zero is no match.
    by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    scores = scores[by_id]
    best = np.argsort(-np.round(scores, 6), axis=0, kind="stable")[:k]
    query = np.broadcast_to(np.arange(len(query_sizes)), best.shape).T.ravel()
    best = best.T.ravel()
    score = scores[best, query]
    hit = score > 0
    return pa.RecordBatch.from_arrays(
        [queries.take(pa.array(query[hit])), ids.take(pa.array(by_id[best[hit]])), pa.array(score[hit])], names=["query_id", "id", "score"])


def fuse(rankings: Sequence[DataFrame], k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, id, rank), ties by id."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "id", "rank") for r in rankings])
    scored = every.groupBy("query_id", "id").agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"))
    order = [F.desc(F.round("score", 12)), "id"]
    if k is not None:
        return top_n(scored, ["query_id"], order, k)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def rank_positions(scores: DataFrame, keys: Sequence[str], order: Sequence, depth: int) -> DataFrame:
    """Places of the best ``depth`` results per query and method."""
    return top_n(scores, list(keys), list(order), depth)


def judged(rankings: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """Relevant results of the first ``depth`` ranks, with the number of relevant ids per query."""
    good = qrels.where(F.col("grade") > 0).select("query_id", "id").distinct()
    n = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = rankings.where(F.col("rank") <= depth).join(good.withColumn("hit", F.lit(True)), ["query_id", "id"], "left")
    return hits.withColumn("hit", F.coalesce("hit", F.lit(False))).join(n, "query_id")


def ideal_gain(relevant: Column, depth: int) -> Column:
    """Gain of a perfect binary ranking: a sum over at most ``depth`` places."""
    parts = [F.when(relevant >= i, 1.0 / math.log2(i + 1)).otherwise(0.0) for i in range(1, depth + 1)]
    return reduce(lambda a, b: a + b, parts)


def quality(judged_rankings: DataFrame, depth: int = 5) -> DataFrame:
    """V8: nDCG, MRR and recall at a depth per method and query. ``judged`` gives the input."""
    rows = judged_rankings.where(F.col("rank") <= depth)
    gain = F.sum(F.when(F.col("hit"), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    return rows.groupBy("method", "query_id").agg(
        gain.alias("dcg"), F.max(F.when(F.col("hit"), 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.count_if("hit").alias("hits"), F.max("relevant").alias("relevant"),
    ).select(
        "method", "query_id",
        (F.col("dcg") / ideal_gain(F.col("relevant"), depth)).alias("ndcg"), "mrr", (F.col("hits") / F.col("relevant")).alias("recall"),
    )


def precision_recall(judged_rankings: DataFrame, depths: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """Precision, recall and F1 for several depths in one pass."""
    cut = F.explode(F.array(*[F.lit(d) for d in depths]))
    rows = judged_rankings.where(F.col("rank") <= max(depths)).withColumn("depth", cut).where(F.col("rank") <= F.col("depth"))
    per = rows.groupBy("method", "query_id", F.col("depth").cast("long").alias("depth")).agg(
        F.count_if("hit").alias("hits"), F.max("relevant").alias("relevant"))
    precision, recall = F.col("hits") / F.col("depth"), F.col("hits") / F.col("relevant")
    f1 = F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return per.select("method", "query_id", "depth", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def mean_quality(per_query: DataFrame, subsets: DataFrame) -> DataFrame:
    """Means per method, overall and per subset (query_id, subset)."""
    return per_query.join(subsets, "query_id").groupingSets([["method"], ["method", "subset"]], "method", "subset").agg(
        F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in ("ndcg", "mrr", "recall")]
    ).withColumn("subset", F.coalesce("subset", F.lit("overall")))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], cells: int = 64) -> DataFrame:
    """Exact percentile of each group: the value at place ceil(share * n).

    Cells end at approximate quantiles of the group, so outliers do not matter. Counts per cell find the cell of each place; only the
    values of those cells are ranked, so no task holds the values of a whole group.
    """
    keys = list(keys)
    steps = [(i + 1) / cells for i in range(cells)]
    stats = df.groupBy(*keys).agg(F.percentile_approx(value, steps).alias("__cuts"), F.count(value).alias("__n"))
    cell = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    rows = spread_join(df.where(F.col(value).isNotNull()), stats, keys).withColumn("__cell", cell)
    counts = rows.groupBy(*keys, "__cell", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("__c"))
    sizes = counts.groupBy(*keys, "__cell").agg(F.sum("__c").alias("__size"))
    upto = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("__end", F.sum("__size").over(upto))
    place = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(float(s)) - 1e-9)).alias("__place")) for s in shares]))
    wanted = stats.select(*keys, place.alias("w")).select(*keys, "w.*")
    hit = sizes.join(wanted, keys).where((F.col("__place") <= F.col("__end")) & (F.col("__place") > F.col("__end") - F.col("__size")))
    inside = Window.partitionBy(*keys, "share").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(hit, [*keys, "__cell"]).withColumn("__at", F.col("__end") - F.col("__size") + F.sum("__c").over(inside))
    return ranked.where(F.col("__at") >= F.col("__place")).groupBy(*keys, "share").agg(F.min("value").alias("value"))


def release_gates(means: DataFrame, latency: DataFrame, sizes: dict, least_queries: int = 80, least_subset: int = 30) -> DataFrame:
    """The named checks and the decision, as one row.

    ``means`` come from ``mean_quality`` for the methods vector and hybrid, ``latency`` has
    (method, p95); ``sizes`` names assets, index_rows, corpus_size, source_size, lexical_size
    and unchanged.
    """
    def cell(method: str, subset: str, metric: str) -> Column:
        return F.max(F.when((F.col("method") == method) & (F.col("subset") == subset), F.col(metric)))

    picks = {f"{m}_{s}_{x}": cell(m, s, x) for m in ("vector", "hybrid") for s in ("overall", "lexical", "semantic") for x in ("ndcg", "recall", "queries")}
    q = means.agg(*[c.alias(name) for name, c in picks.items()])
    p95 = latency.agg(*[F.max(F.when(F.col("method") == m, F.col("p95"))).alias(f"{m}_p95") for m in ("vector", "hybrid")])
    row = q.withColumn("__one", F.lit(1)).join(p95.withColumn("__one", F.lit(1)), "__one")
    c, e = F.col, 1e-12
    gain = {x: c(f"hybrid_{x}") - c(f"vector_{x}") for x in ("overall_ndcg", "lexical_ndcg", "semantic_ndcg", "overall_recall")}
    checks = {
        "complete_corpus": (F.lit(sizes["assets"]) == F.lit(sizes["index_rows"])) & (F.lit(sizes["assets"]) == F.lit(sizes["corpus_size"])),
        "representative_query_coverage": (c("vector_overall_queries") >= least_queries) & (c("vector_lexical_queries") >= least_subset)
        & (c("vector_semantic_queries") >= least_subset),
        "overall_ndcg_floor": gain["overall_ndcg"] >= -0.01 - e,
        "lexical_ndcg_gain": gain["lexical_ndcg"] >= 0.05 - e,
        "semantic_ndcg_floor": gain["semantic_ndcg"] >= -0.02 - e,
        "overall_recall_floor": gain["overall_recall"] >= -0.02 - e,
        "latency_absolute": c("hybrid_p95") - c("vector_p95") <= 25.0,
        "latency_ratio": c("hybrid_p95") <= c("vector_p95") * 1.5,
        "storage_ratio": F.lit(sizes["lexical_size"]) <= F.lit(sizes["source_size"]) * 0.25,
        "source_index_unchanged": F.lit(sizes["unchanged"]),
    }
    out = row.select(*[F.coalesce(check, F.lit(False)).alias(name) for name, check in checks.items()])
    decision = (
        F.when(~c("representative_query_coverage"), "NO_GO_INSUFFICIENT_EVIDENCE")
        .when(reduce(lambda a, b: a & b, [c(name) for name in checks]), "GO_P1_PROTOTYPE").otherwise("NO_GO")
    )
    return out.withColumn("decision", decision)


def suite_violations(queries: DataFrame, judgments: DataFrame, sources: DataFrame) -> DataFrame:
    """What makes a query suite unfit: (query_id, subset), (query_id, source_path, grade)."""
    twice = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    empty = queries.select("query_id").distinct().join(judgments.select("query_id"), "query_id", "left_anti")
    unknown = judgments.join(sources.select("source_path").distinct(), "source_path", "left_anti")
    parts = [
        (queries.where(~F.coalesce(F.col("subset").isin("lexical", "semantic"), F.lit(False))), "unsupported_subset"),
        (twice, "duplicate_query_id"),
        (judgments.where(~F.coalesce(F.col("grade").isin(1, 2), F.lit(False))), "invalid_grade"),
        (unknown, "judgment_without_document"),
        (empty, "query_without_judgment"),
    ]
    return reduce(DataFrame.unionByName, [df.select("query_id", F.lit(name).alias("violation")).distinct() for df, name in parts])

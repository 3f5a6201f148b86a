"""V6: a stored word index in blocks, changed by runs, read by block-max skipping.

An index is a folder of runs. A run holds the documents it brought (``documents``: id, block, length, distinct terms and their weighted
frequencies), the earlier entries it ended (``dead``: id, run, block), their postings in blocks (``blocks``) and what it changed in the
counts (``terms``, ``totals``). The list of finished runs is a snapshot whose pointer moves last, so a run that died is never read.

Postings travel as lists of numbers and are counted, bounded and scored by matrices in pieces of bounded size; no posting becomes a row.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.search import search_tokens
from skein.operators import retrieval as R
from skein.operators.retrieval import B, K1, LEAST_IDF
from skein.operators.skew import top_n
from skein.sources.snapshots import read_snapshot, stored, write_snapshot

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Documents per block, on average, and folders that the terms of a run are dealt to.
BLOCK_DOCUMENTS = 64
BUCKETS = 16
RUNS = "run long, folder string"
#: Scores are compared at six digits; a bound this much below the k-th score cannot matter.
SLACK = 2e-6

SCHEMAS = {
    "documents": "id long, block long, length long, terms array<string>, wtf array<double>, run long",
    "dead": "id long, run long, block long",
    "blocks": "term string, block long, n long, best array<struct<wtf:double,length:long>>, ids array<long>, wtf array<double>, lengths array<long>, run long, bucket int",
    "terms": "term string, df long",
    "totals": "documents long, words long",
}


def runs(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """Finished runs: a row per run, so a list of runs is small."""
    return sorted((r.run, r.folder) for r in read_snapshot(spark, f"{table}/runs", RUNS).collect())


def _table(spark: SparkSession, finished: Sequence[tuple[int, str]], name: str) -> DataFrame:
    """One table of all given runs."""
    parts = [spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}") for _, folder in finished]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMAS[name])


def live_documents(spark: SparkSession, table: str) -> DataFrame:
    """Documents as of the last finished run: id, block, length, terms, wtf, run."""
    done = runs(spark, table)
    return _table(spark, done, "documents").join(_table(spark, done, "dead"), ["id", "run"], "left_anti")


def index_run(documents: DataFrame, table: str, weights: dict[str, float], removed: DataFrame | None = None, block_documents: int = BLOCK_DOCUMENTS) -> int:
    """Add a run: ``documents`` (id and the fields of ``weights``; ids once each) are new or replace what the index has, ``removed`` (id) go.

    Null fields count as empty. Work follows the changed documents, but for one look at the ids of the live ones. Returns the run's number.
    """
    spark = documents.sparkSession
    done = runs(spark, table)
    number = done[-1][0] + 1 if done else 0
    folder = f"{table}/run-{number}-{uuid.uuid4().hex}"
    old = live_documents(spark, table)
    count = documents.count()
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // block_documents))).cast("long"))
    # Words are counted where a document is read, once; one shuffle, of the counted documents by block, brings the postings of a block together.
    arrays = documents.select("id", block.alias("block"), *[search_tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in weights])
    own_weights = [float(w) for w in weights.values()]
    own = arrays.mapInArrow(lambda batches: _counted(batches, own_weights), "id long, block long, length long, terms array<string>, wtf array<double>")
    own.withColumn("run", F.lit(number).cast("long")).write.parquet(f"{folder}/documents")
    own = spark.read.schema(SCHEMAS["documents"]).parquet(f"{folder}/documents")

    gone = own.select("id") if removed is None else own.select("id").unionByName(removed.select("id")).distinct()
    ended = stored(old.select("id", "run", "block", "length", "terms").join(gone, "id", "left_semi"), "ended")
    ended.select("id", "run", "block").write.parquet(f"{folder}/dead")

    placed = own.select("block", "id", "length", "terms", "wtf").repartition("block").sortWithinPartitions("block")
    packed = placed.mapInArrow(lambda batches: _whole(batches, 1, _postings), POSTINGS).withColumn("run", F.lit(number).cast("long"))
    packed = packed.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    packed.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/blocks")

    changes = own.select(F.explode("terms").alias("term"), F.lit(1).alias("by")).unionByName(ended.select(F.explode("terms").alias("term"), F.lit(-1).alias("by")))
    changes.groupBy("term").agg(F.sum("by").alias("df")).where(F.col("df") != 0).write.parquet(f"{folder}/terms")
    sizes = own.select(F.lit(1).alias("by"), "length").unionByName(ended.select(F.lit(-1).alias("by"), "length"))
    sizes.agg(F.coalesce(F.sum("by"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.col("by") * F.col("length")), F.lit(0)).alias("words")).write.parquet(f"{folder}/totals")
    write_snapshot(spark.createDataFrame([*done, (number, folder)], RUNS).coalesce(1), f"{table}/runs")
    return number


POSTINGS = "term string, block long, n long, best array<struct<wtf:double,length:long>>, ids array<long>, wtf array<double>, lengths array<long>"
#: Most blocks, and most postings but for a block that has more, that are packed as one row.
PACKED_BLOCKS = 64
PACKED_POSTINGS = 200_000


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Places where any of the keys differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _counted(batches: Iterator[pa.RecordBatch], weights: list[float]) -> Iterator[pa.RecordBatch]:
    """Rows (id, block, tokens of each field) as rows (id, block, length, terms, wtf)."""
    for batch in batches:
        lengths = sum(_sizes(c) for c in batch.columns[2:])
        for low, high in R._pieces(lengths, batch.num_rows, R.COUNTED):
            part, length = batch.slice(low, high - low), lengths[low:high]
            tokens = pa.table({
                "row": np.concatenate([np.repeat(np.arange(high - low), _sizes(c)) for c in part.columns[2:]]),
                "term": pa.chunked_array([c.flatten() for c in part.columns[2:]]),
                "w": np.concatenate([np.full(int(_sizes(c).sum()), w) for c, w in zip(part.columns[2:], weights)])})
            found = tokens.group_by(["row", "term"], use_threads=False).aggregate([("w", "sum")]).sort_by([("row", "ascending"), ("term", "ascending")]).combine_chunks()
            starts = np.searchsorted(found["row"].to_numpy(), np.arange(high - low))
            term, wtf = (pa.concat_arrays(found[c].chunks) if found.num_rows else pa.array([], kind) for c, kind in (("term", pa.string()), ("w_sum", pa.float64())))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(length), _lists(term, starts), _lists(wtf, starts)],
                                             names=["id", "block", "length", "terms", "wtf"])


def _whole(batches: Iterator[pa.RecordBatch], keys: int, run: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run`` over pieces of rows sorted by their first ``keys`` columns (numbers), never cut within a key, and the places where keys start."""
    def pieces(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new = _starts(*[rows.column(i).to_numpy() for i in range(keys)])
        sizes = np.add.reduceat(1 + sum(_sizes(c) for c in rows.columns if pa.types.is_list(c.type)) + np.zeros(rows.num_rows, np.int64), new)
        ends = np.r_[new[1:], rows.num_rows]
        for low, high in R._pieces(sizes, PACKED_BLOCKS, PACKED_POSTINGS):
            yield run(rows.slice(int(new[low]), int(ends[high - 1] - new[low])), new[low:high] - new[low])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _starts(*[batch.column(i).to_numpy() for i in range(keys)])
        if held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(keys)):
            new = new[1:]
        if not len(new):
            held.append(batch)
            continue
        ready = pa.concat_batches([*held, batch.slice(0, int(new[-1]))])
        held = [batch.slice(int(new[-1]))]
        if ready.num_rows:
            yield from pieces(ready)
    if held:
        yield from pieces(pa.concat_batches(held))


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the distinct values, null among them, and these."""
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _postings(rows: pa.RecordBatch, _) -> pa.RecordBatch:
    """Counted documents (block, id, length, terms, wtf) of whole blocks as rows of ``POSTINGS``. Rows of one id and length count as one document."""
    size = _sizes(rows.column("terms"))
    block, length = (np.repeat(rows.column(c).to_numpy(), size) for c in ("block", "length"))
    (code, terms), (own, ids) = _codes(rows.column("terms").flatten()), _codes(rows.column("id"))
    own, wtf = np.repeat(own, size), rows.column("wtf").flatten().to_numpy()
    order = np.lexsort((length, own, code, block))
    block, code, own, length, wtf = block[order], code[order], own[order], length[order], wtf[order]
    one = _starts(block, code, own, length)
    wtf = np.add.reduceat(wtf, one) if len(one) else wtf
    block, code, own, length = block[one], code[one], own[one], length[one]
    starts = _starts(block, code)
    n = np.diff(np.r_[starts, len(one)])
    # No other posting of the list beats the best ones in both: the best part of the list is among them for any mean length.
    group = np.repeat(np.arange(len(starts)), n)
    order = np.lexsort((length, -wtf, group))
    step = length[order] - group[order] * (int(length.max(initial=0)) + 1)
    best = order[np.r_[True, step[1:] < np.minimum.accumulate(step)[:-1]][: len(step)]]
    pairs = pa.StructArray.from_arrays([pa.array(wtf[best]), pa.array(length[best])], names=["wtf", "length"])
    return pa.RecordBatch.from_arrays(
        [terms.take(pa.array(code[starts])), pa.array(block[starts]), pa.array(n), _lists(pairs, np.searchsorted(group[best], np.arange(len(starts)))),
         _lists(ids.take(pa.array(own)), starts), _lists(pa.array(wtf), starts), _lists(pa.array(length), starts)],
        names=["term", "block", "n", "best", "ids", "wtf", "lengths"])


def _part(wtf: Column | np.ndarray, length: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """What one posting adds to a score, for a word of weight one: rises with the frequency, falls with the length."""
    return wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * length / mean))


def search(spark: SparkSession, table: str, queries: DataFrame, k: int, first_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Best k documents per query (query_id, text) as ``bm25`` ranks them, and what each query read.

    The best part that each word can add in a block bounds the scores of its documents. The ``first_blocks`` of the
    highest bounds (2 k + 8 unless given: each has a posting, so k are likely found) are read first; of the rest, only blocks whose bound reaches the k-th score found so far. A document lies in
    one block of one run, so nothing is lost whatever ``first_blocks`` is. The second frame has a row per query with a known word:
    blocks and postings of its words, and how many of them were read.
    """
    done = runs(spark, table)
    totals = _table(spark, done, "totals").agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
    n, mean = totals.documents or 0, (totals.words or 0) / max(totals.documents or 0, 1) or 1.0
    words = queries.select("query_id", F.explode(search_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    df = _table(spark, done, "terms").join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)
    weight = F.col("qtf") * F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    known = stored(words.where(F.col("query_id").isNotNull()).join(df, "term").select("query_id", "term", weight.alias("weight"), bucket.alias("bucket")), "query-words")
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = known.groupBy("query_id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("word"), "weight")).alias("words"))
    asked = asked.select("query_id", "words.word", "words.weight", F.lit(mean).alias("mean"))
    asked = stored(asked.mapInArrow(R._query_blocks, f"queries array<{kind}>, q_sizes binary, q_words binary, weights binary, mean double"), "query-blocks")
    terms = known.select("bucket", "term").distinct()

    blocks = _table(spark, done, "blocks")
    top = F.array_max(F.transform("best", lambda e: _part(e["wtf"], e["length"], mean)))
    heads = blocks.select("bucket", "term", "run", "block", "n", "best").join(terms, ["bucket", "term"], "left_semi").select("run", "block", F.xxhash64("term").alias("word"), top.alias("top"), "n")
    heads = heads.repartition("run", "block").sortWithinPartitions("run", "block").mapInArrow(lambda batches: _whole(batches, 2, _heads), HEADS)
    bounds = heads.crossJoin(asked).mapInArrow(_pairs(_bounds), f"query_id {kind}, run long, block long, bound double, postings long")
    bounds = stored(bounds, "bounds")
    first = stored(top_n(bounds, ["query_id"], [F.desc("bound"), "run", "block"], first_blocks or 2 * k + 8, "place"), "first-blocks")

    dead = _table(spark, done, "dead").where(F.col("id").isNotNull()).groupBy("run", "block").agg(F.collect_list("id").alias("ids"))

    def scored(wanted: DataFrame) -> DataFrame:
        """The k best documents per piece of some blocks, for the queries that want their block."""
        met = wanted.groupBy("run", "block").agg(F.collect_list("query_id").alias("wanted"))
        # A block's postings go to one task once, however many queries want them, with its queries and its dead documents; it is scored there.
        wants = blocks.select("bucket", "term", "run", "block", "ids", "wtf", "lengths").join(terms, ["bucket", "term"], "left_semi").join(met.select("run", "block"), ["run", "block"], "left_semi")
        ended = dead.join(met.select("run", "block"), ["run", "block"], "left_semi")
        rows = wants.select("run", "block", F.xxhash64("term").alias("word"), "ids", "wtf", "lengths").unionByName(met, True).unionByName(ended, True)
        rows = rows.repartition("run", "block").sortWithinPartitions("run", "block")
        pieces = rows.mapInArrow(lambda batches: _whole(batches, 2, _scorable), SCORABLE.format(kind=kind))
        return pieces.crossJoin(asked).mapInArrow(_pairs(lambda pair: _best(pair, k)), f"query_id {kind}, id long, score double")

    early = stored(scored(first), "early-scores")
    order = [F.desc(F.round("score", 6)), "id"]
    least = top_n(early, ["query_id"], order, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first.select("query_id", "run", "block"), ["query_id", "run", "block"], "left_anti").join(least, "query_id", "left")
    late = stored(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "run", "block", "postings"), "late-blocks")
    ranking = top_n(early.unionByName(scored(late)), ["query_id"], order, k)

    read = first.select("query_id", "postings").unionByName(late.select("query_id", "postings")).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("blocks_read"), F.sum("postings").alias("postings_read"))
    whole = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("postings").alias("postings"))
    return ranking, whole.join(read, "query_id")


HEADS = "runs array<long>, blocks array<long>, sizes binary, words binary, tops binary, n binary"
SCORABLE = "ids array<long>, blocks binary, places binary, words binary, wtf binary, lengths binary, wanted array<{kind}>, wanted_blocks binary"


def _row(**columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    """One row: Arrow arrays become lists, numbers bytes."""
    cells = [_lists(c, np.array([0])) if isinstance(c, pa.Array) else pa.array([c.tobytes()], pa.binary()) for c in columns.values()]
    return pa.RecordBatch.from_arrays(cells, names=list(columns))


def _numbers(row: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row.column(name)[0].as_buffer(), kind)


def _pairs(run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over rows that are a piece of the index and a block of queries."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield run(batch.slice(i, 1))

    return each


def _heads(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
    """Rows (run, block, word, top, n) of whole blocks as one row."""
    word, top, n = (rows.column(c).to_numpy() for c in ("word", "top", "n"))
    at = pa.array(new)
    return _row(runs=rows.column("run").take(at), blocks=rows.column("block").take(at), sizes=np.diff(np.r_[new, rows.num_rows]).astype("<i8"), words=word.astype("<i8"), tops=top.astype("<f8"), n=n.astype("<i8"))


def _scorable(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
    """Postings (word, ids, wtf, lengths), queries (wanted) and dead documents (ids alone) of whole blocks as one row."""
    block = np.repeat(np.arange(len(new)), np.diff(np.r_[new, rows.num_rows]))
    size, wanted = _sizes(rows.column("ids")), rows.column("wanted")
    posting = np.repeat(rows.column("word").is_valid().to_numpy(zero_copy_only=False), size)
    own, ids = _codes(rows.column("ids").flatten())
    key = own * len(new) + np.repeat(block, size)
    live = ~np.isin(key[posting], key[~posting])
    distinct, place = np.unique(key[posting][live], return_inverse=True)
    word = np.repeat(pc.fill_null(rows.column("word"), 0).to_numpy(), size)[posting][live]
    wtf, lengths = (rows.column(c).flatten().to_numpy()[live] for c in ("wtf", "lengths"))
    return _row(ids=ids.take(pa.array(distinct // len(new))), blocks=(distinct % len(new)).astype("<i4"), places=place.astype("<i4"), words=word.astype("<i8"), wtf=wtf.astype("<f8"), lengths=lengths.astype("<i8"),
                wanted=wanted.flatten(), wanted_blocks=np.repeat(block, _sizes(wanted)).astype("<i4"))


def _strips(pair: pa.RecordBatch, rows: np.ndarray, count: int, *values: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Matrices (row, word) of the values and (word, query) of the weights, for some words of the queries at a time."""
    sizes = _numbers(pair, "q_sizes", "<i4")
    asking = np.repeat(np.arange(len(sizes)), sizes)
    words, weights = _numbers(pair, "words", "<i8"), _numbers(pair, "weights", "<f8")
    vocabulary = np.intersect1d(words, _numbers(pair, "q_words", "<i8"))
    if not len(vocabulary):
        return
    def placed(own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
        return np.where(vocabulary[at] == own, at, -1)

    place, asked = placed(words), placed(_numbers(pair, "q_words", "<i8"))
    for low in range(0, len(vocabulary), R.STRIP):
        width = min(R.STRIP, len(vocabulary) - low)
        here, there = (place >= low) & (place < low + width), (asked >= low) & (asked < low + width)
        left = [np.bincount(rows[here] * width + place[here] - low, v[here], count * width).reshape(-1, width) for v in values]
        yield left, np.bincount((asked[there] - low) * len(sizes) + asking[there], weights[there], width * len(sizes)).reshape(width, -1)


def _bounds(pair: pa.RecordBatch) -> pa.RecordBatch:
    """Per query and block with a word of it: the most that its documents can score, and their postings."""
    queries, sizes = pair.column("queries").flatten(), _numbers(pair, "sizes", "<i8")
    bound, postings = np.zeros((2, len(sizes), len(queries)))
    for (top, n), weight in _strips(pair, np.repeat(np.arange(len(sizes)), sizes), len(sizes), _numbers(pair, "tops", "<f8"), _numbers(pair, "n", "<i8")):
        bound += top @ weight
        postings += n @ (weight > 0)
    block, query = np.nonzero(postings)
    return pa.RecordBatch.from_arrays(
        [queries.take(pa.array(query)), pair.column("runs").flatten().take(pa.array(block)), pair.column("blocks").flatten().take(pa.array(block)),
         pa.array(bound[block, query]), pa.array(postings[block, query].astype(np.int64))], names=["query_id", "run", "block", "bound", "postings"])


def _best(pair: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Best k documents of a piece for each query of a block, of the index blocks that the query wants."""
    ids, queries, block = pair.column("ids").flatten(), pair.column("queries").flatten(), _numbers(pair, "blocks", "<i4")
    wtf, length = _numbers(pair, "wtf", "<f8"), _numbers(pair, "lengths", "<i8")
    part = _part(wtf, length, pair.column("mean")[0].as_py())
    asking = pc.index_in(pair.column("wanted").flatten(), value_set=queries)
    mine = asking.is_valid().to_numpy(zero_copy_only=False)
    wanted = np.zeros((int(block.max(initial=-1)) + 1, len(queries)), bool)
    at, asking = _numbers(pair, "wanted_blocks", "<i4")[mine], pc.drop_null(asking).to_numpy()
    wanted[at[at < len(wanted)], asking[at < len(wanted)]] = True
    scores = np.zeros((len(ids), len(queries)))
    if wanted.any():
        for (left,), weight in _strips(pair, _numbers(pair, "places", "<i4").astype(np.int64), len(ids), part):
            scores += left @ weight
        scores[~wanted[block]] = 0
    # Ties by id, so the documents are taken in its order; a score of zero is no match.
    by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    scores = scores[by_id]
    best = np.argsort(-np.round(scores, 6), axis=0, kind="stable")[:k]
    query = np.broadcast_to(np.arange(len(queries)), best.shape).T.ravel()
    best = best.T.ravel()
    score = scores[best, query]
    hit = score > 0
    return pa.RecordBatch.from_arrays([queries.take(pa.array(query[hit])), ids.take(pa.array(by_id[best[hit]])), pa.array(score[hit])], names=["query_id", "id", "score"])

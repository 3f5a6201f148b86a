"""Vector search, ranking, fusion and quality."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import search
from skein.operators import retrieval as R
from skein.operators import vectors as V


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    points = np.concatenate([c + 0.2 * rng.normal(size=(40, 16)) for c in centers]).astype(np.float32)
    return np.concatenate([points, points[:20]])


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, embedding array<float>").repartition(6).persist()


def brute(data, q, k):
    points = data.astype(np.float64)
    d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
    return [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(d)), d))[:k]]


@pytest.mark.parametrize("block", [4096, 100])
def test_knn(vectors, data, block):
    queries = vectors.select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in V.knn(vectors, queries, 7, block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    assert len(got) == len(data)
    for q, rows in got.items():
        want = brute(data, q, 7)
        assert [r[1] for r in sorted(rows)] == [i for i, _ in want]
        assert [r[2] for r in sorted(rows)] == pytest.approx([d for _, d in want])


def test_nearest(vectors, data):
    got = [(r.id, r.distance) for r in V.nearest(vectors, [float(x) for x in data[5]], 4).collect()]
    assert [i for i, _ in got] == [i for i, _ in brute(data, 5, 4)]


def test_similar_leaves_itself_out(vectors, spark):
    names = vectors.select("id", F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"))
    assert V.find_similar(vectors, names, "n5", 3).count() == 3
    assert 5 not in {r.id for r in V.find_similar(vectors, names, "n5", 3).collect()}
    assert V.find_similar(vectors, names, "unknown", 3).count() == 0


def test_approximate_recall(vectors, data):
    queries = vectors.select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r.id) for r in V.approximate_knn(vectors, queries, 5, cells=12, probes=3).collect()}
    want = {(q, i) for q in range(len(data)) for i, _ in brute(data, q, 5)}
    assert len(got & want) / len(want) > 0.95


def test_clusters(vectors, spark):
    with_gap = vectors.unionByName(spark.createDataFrame([(10_000, None)], vectors.schema))
    found, cost = V.clusters(with_gap, 12, 16, restarts=3)
    assert found.count() == vectors.count() + 1 and cost > 0
    few, _ = V.clusters(vectors.limit(3), 10, 16, restarts=1)
    assert few.select("cluster").distinct().count() <= 3


def test_embedding_dimension_is_checked(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="expected"):
        V.embed_with(df, lambda texts: [[1.0] for _ in texts], 2).collect()


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "blue whale")], "id long, text string")
    v = {r.id: np.array(r.embedding) for r in V.embed_texts(df, search.search_tokens(F.col("text")), 64).collect()}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[3]) - 1) < 1e-5


def ranking(spark, ids, method="m"):
    return spark.createDataFrame([(method, "q", i, n) for n, i in enumerate(ids, 1)], "method string, query_id string, id string, rank long")


def test_quality(spark):
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "z", 0)], "query_id string, id string, grade int")
    row = R.quality(R.judged(ranking(spark, ["other", "a", "b"]), qrels, 5)).first()
    want = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert row.mrr == 0.5 and row.recall == 1.0 and row.ndcg == pytest.approx(want)


def test_fusion_ties_go_by_id(spark):
    fused = R.fuse([ranking(spark, ["b"]), ranking(spark, ["a"])]).orderBy("rank").collect()
    assert [r.id for r in fused] == ["a", "b"]
    again = R.fuse([ranking(spark, ["a"]), ranking(spark, ["b"])]).orderBy("rank").collect()
    assert [(r.id, r.score) for r in fused] == [(r.id, r.score) for r in again]


def test_nearest_rank(spark):
    rnd = random.Random(2)
    groups = {"small": [1.0, 2.0, 3.0, 4.0], "one": [7.0], "big": [rnd.gauss(0, 1) for _ in range(500)] + [1e6] + [0.0] * 200}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {(r.g, r.share): r.value for r in R.nearest_rank(df, ["g"], "v", [0.5, 0.95, 1.0], cells=16).collect()}
    for g, vs in groups.items():
        for share in (0.5, 0.95, 1.0):
            assert got[(g, share)] == sorted(vs)[max(1, math.ceil(share * len(vs))) - 1]
    assert got[("small", 0.95)] == 4.0


def test_tokens(spark):
    def words(text):
        return spark.range(1).select(search.tokens(F.lit(text)).alias("t")).first().t

    assert words("ASP.NET REST API") == ["ASP", "NET", "REST", "API"] and words("--- !") == []
    assert spark.range(1).select(search.fold(F.lit("Éléphant Ångström naïve ß")).alias("f")).first().f == "elephant angstrom naive ß"


def test_bm25_order(spark):
    docs = spark.createDataFrame(
        [(1, "fox", "x", "y"), (2, "x", "fox", "y"), (3, "x", "y", "fox"), (4, "x", "y", "z"), (5, "q", "r", "s"), (6, "t", "u", "v"), (7, "t", "u", "w")],
        "id long, title string, description string, body string")
    index = R.postings(docs, {"title": 8, "description": 4, "body": 1})
    queries = spark.createDataFrame([(1, "FÖX"), (2, "nothing")], "query_id long, text string")
    rows = R.bm25(index, 7, queries, 5).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in rows] == [(1, 1), (1, 2), (1, 3)] and rows[0].score > rows[1].score > rows[2].score > 0


def gates(spark, lexical_size, queries):
    rows = [(m, s, queries if s == "overall" else queries // 2, 0.9 + (0.06 if m == "hybrid" else 0), 1.0, 0.9)
            for m in ("vector", "hybrid") for s in ("overall", "lexical", "semantic")]
    means = spark.createDataFrame(rows, "method string, subset string, queries long, ndcg double, mrr double, recall double")
    latency = spark.createDataFrame([("vector", 20.0), ("hybrid", 25.0)], "method string, p95 double")
    sizes = {"assets": 196, "index_rows": 196, "corpus_size": 196, "source_size": 1000, "lexical_size": lexical_size, "unchanged": True}
    return R.release_gates(means, latency, sizes).first()


def test_gates(spark):
    assert gates(spark, 250, 80).decision == "GO_P1_PROTOTYPE"
    big = gates(spark, 251, 80)
    assert big.decision == "NO_GO" and not big.storage_ratio
    assert gates(spark, 250, 18).decision == "NO_GO_INSUFFICIENT_EVIDENCE"


def test_suite(spark):
    queries = spark.createDataFrame([("1", "lexical"), ("1", "semantic"), ("2", "odd"), ("3", "lexical")], "query_id string, subset string")
    judgments = spark.createDataFrame([("1", "p", 1), ("2", "p", 3), ("3", "gone", 2)], "query_id string, source_path string, grade int")
    sources = spark.createDataFrame([("p",)], "source_path string")
    got = {(r.query_id, r.violation) for r in R.suite_violations(queries, judgments, sources).collect()}
    assert got == {("1", "duplicate_query_id"), ("2", "unsupported_subset"), ("2", "invalid_grade"), ("3", "judgment_without_document")}


def test_recall_needs_no_window_over_all_queries(spark, sf):
    from skein.plans import load_all
    from skein.plans.registry import QUERIES

    load_all()
    found = QUERIES["v5_approximate_knn"](spark, sf)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_quantised_search_against_brute_force(vectors, data, spark):
    from skein.operators import quantised as Q

    queries = vectors.where(F.col("id") % 10 == 0).select(F.col("id").alias("query_id"), "embedding")
    model = Q.fit(vectors, cells=12, parts=5, codes=64)
    index = Q.encoded(vectors, model, block=64).persist()
    assert sorted(i for r in index.collect() for i in np.frombuffer(r.ids, "<i8").tolist()) == list(range(len(data)))
    found = Q.candidates(index, model, queries, 40, probes=4).persist()
    got = {(r.query_id, r.id): r.distance for r in Q.reranked(found, vectors, queries, 5).collect()}
    want = {(q, i): d for q in range(0, len(data), 10) for i, d in brute(data, q, 5)}
    assert len(got) == len(want) and len(got.keys() & want.keys()) / len(want) > 0.95
    assert all(got[x] == pytest.approx(want[x], abs=1e-6) for x in got.keys() & want.keys())
    assert found.groupBy("query_id").count().where("count > 40").count() == 0
    # All cells and all vectors as candidates: exact.
    whole = Q.reranked(Q.candidates(index, model, queries, len(data), probes=12), vectors, queries, 5)
    assert {(r.query_id, r.id) for r in whole.collect()} == want.keys()


def test_quantised_codes_of_few_distinct_vectors_are_exact(spark):
    from skein.operators import quantised as Q

    rows = [(i, [float(i % 3), 1.0, float(i % 2)]) for i in range(30)] + [(99, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    model = Q.fit(v, cells=2, parts=8)
    queries = v.where("id < 6").select(F.col("id").alias("query_id"), "embedding")
    got = Q.reranked(Q.candidates(Q.encoded(v, model), model, queries, 5, probes=2), v, queries, 5).collect()
    # Copies tie at distance zero and go by id.
    assert sorted((r.query_id, r.rank, r.id) for r in got) == [(q, n + 1, q + 6 * n) for q in range(6) for n in range(5)]
    assert {r.distance for r in got} == {0.0}
    with pytest.raises(ValueError):
        Q.fit(v.where("id = 99"))


def test_search_figures(spark, sf):
    from skein.plans import load_all
    from skein.plans.registry import QUERIES

    load_all()
    row = QUERIES["v5_search_figures"](spark, sf).first()
    assert row.queries == 10 and row.recall >= 0.9 and row.share_read <= 0.1


def test_bm25_in_blocks_equals_sums_over_postings(spark):
    """F16: repeated and null ids, null queries, ties of copies, several blocks; no score is shuffled."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [(rng.choice([None, *range(40)]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(150)] + [(i, "w1 w2 copy") for i in range(100, 130)]
    docs = spark.createDataFrame(texts, "id long, body string").repartition(3)
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (1, "w3"), (None, "w4 copy"), (2, "nothing"), (3, None)], "query_id long, text string")
    n = len(texts)
    tf, length, total = {}, {}, 0
    groups = {}
    for i, text in texts:
        own = text.split()
        groups.setdefault((i, len(own)), []).extend(own)
        total += len(own)
    for (i, size), own in groups.items():
        for w in set(own):
            tf[i, size, w] = own.count(w)
    df = {w: sum(1 for k in tf if k[2] == w) for w in {k[2] for k in tf}}
    want = {}
    for query, ws in ((1, ["w1", "w2", "w2", "w3"]), (None, ["w4", "copy"])):
        sums = {}
        for (i, size, w), f in tf.items():
            idf = max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6)
            sums[i] = sums.get(i, 0) + ws.count(w) * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / (total / n)))
        order = sorted((i for i in sums if sums[i] > 0), key=lambda i: (-round(sums[i], 6), i is not None, i or 0))[:6]
        want |= {(query, rank): (i, pytest.approx(sums[i])) for rank, i in enumerate(order, 1)}
    found = R.ranked(R.indexed(docs, {"body": 1}), n, asked, 6)
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in found.collect()} == want
    assert {(r.query_id, r["rank"]): r.id for r in R.bm25(R.postings(docs, {"body": 1}), n, asked, 6).collect()} == {k: v[0] for k, v in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_passages_inside_words_and_short_ones(spark, tmp_path):
    """a passage that starts or ends within a word, and passages of few words, are found as SQL finds them; rankings are computed once."""
    from skein.plans import retrieval as P
    from skein.plans.registry import Tables
    from skein.session import prepare

    docs = [(1, "xone two three four five six sevenx"), (2, "one two three four five six seven"), (3, "one two  three four five six seven"), (4, "short"), (5, None)]
    passages = [(10, "one two three four five six seven"), (11, "hor"), (12, None)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    t = Tables(prepare(spark), str(tmp_path))
    assert {(r.query_id, r.id) for r in P.qrels(t).collect()} == {(10, 1), (10, 2), (11, 4)}
    plan = P.methods(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and "Window" not in plan


def test_a_piece_keeps_a_query_s_candidates_of_all_its_cells(spark):
    """However many cells a query probes and however the index was written, what is shuffled is bounded by pieces."""
    from skein.operators import quantised as Q

    rnd = np.random.default_rng(5)
    points = rnd.normal(size=(600, 6))
    model = Q.fit(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>"), cells=20, parts=3, codes=16)
    cells = np.sort(model.far(points).argmin(axis=1)).astype("<i4")
    order = np.argsort(model.far(points).argmin(axis=1), kind="stable")
    codes = model.codes(points[order], cells)
    got = pd.concat(Q._candidates(model, 20, np.arange(70), points[:70], cells, order, codes, 9))
    assert got.groupby("query_id").size().eq(9).all()
    decoded = model.centers[cells] + np.concatenate([book[codes[:, p]] for p, book in enumerate(model.books)], axis=1)
    for q in (0, 69):
        far = ((decoded - points[q]) ** 2).sum(axis=1)
        assert set(got[got["query_id"] == q]["id"]) == set(order[np.lexsort((order, far.round(9)))[:9]])


def test_every_vector_is_asked(spark, tmp_path):
    """Ids that 50 does not divide are queries as well."""
    from skein.plans import load_all
    from skein.plans.registry import QUERIES

    load_all()
    rnd = np.random.default_rng(6)
    points = rnd.normal(size=(90, 6)).astype(np.float32)
    spark.createDataFrame([(i + 1, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i + 1, "en", "web") for i in range(90)], "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {q + 1: [i + 1 for i, _ in brute(points, q, 6)] for q in range(90)}
    for name, k in (("v1_exact_knn", 5), ("t45_similarity", 3), ("v2_search_assets", 5), ("v3_similar_for_all", 5)):
        got = {}
        for r in QUERIES[name](spark, str(tmp_path)).collect():
            got.setdefault(r.query_id, set()).add(r.id)
        assert got == {q: set(ids[1:6] if name.startswith("v3") else ids[:k]) for q, ids in want.items()}
    rows = QUERIES["v5_approximate_knn"](spark, str(tmp_path)).collect()
    assert sorted(r.query_id for r in rows) == list(range(1, 91)) and all(r.results == 5 and r.distances_true and r.read_a_tenth for r in rows)


@pytest.mark.parametrize("strip, piece", [(70, 150), (10_000, 40)])
def test_strips_meet_slots(spark, data, monkeypatch, strip, piece):
    """several strips and slots, copies that tie by id, repeated ids on both sides, null vectors."""
    from skein.operators import quantised as Q

    monkeypatch.setattr(V, "STRIP", strip)
    monkeypatch.setattr(V, "PIECE", piece)
    monkeypatch.setattr(V, "PAIRS", 50)
    rows = [(i % 400, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame([*rows, (9000, None)], "id long, embedding array<float>").repartition(3)
    asked = df.where("id < 90").select(F.col("id").alias("query_id"), "embedding")
    distance = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    want = {}
    for q, e in rows:
        if q < 90:
            want.setdefault(q, []).extend((distance(e, v), i) for i, v in rows)
    want = {q: [(i, pytest.approx(d, abs=1e-9)) for d, i in sorted((round(d, 12), i) for d, i in all_)[:6]] for q, all_ in want.items()}

    def ranked(found):
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.id, r.distance))
        return got

    assert ranked(V.knn(df, asked, 6, 16)) == want
    # Every pair of ids that is named once is compared for each of its vectors, as in a join.
    pairs = asked.select("query_id").distinct().crossJoin(df.select("id").distinct())
    monkeypatch.setattr(Q, "PIECE", piece)
    monkeypatch.setattr(Q, "PAIRS", 50)
    assert ranked(Q.reranked(pairs, df, asked, 6)) == want


def test_decoded_candidates_in_strips_and_slots(spark, data, monkeypatch):
    """however queries and pieces are dealt, a query's candidates are the nearest decoded vectors of the cells that it probes."""
    from skein.operators import quantised as Q

    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, embedding array<float>").repartition(4)
    model = Q.fit(df, cells=9, parts=4, codes=16)
    index = Q.encoded(df, model, block=32).persist()
    queries = df.select(F.col("id").alias("query_id"), "embedding")
    for name, value in (("STRIP", 60), ("SLOT", 120), ("SHOWN", 33), ("PIECE", 50)):
        monkeypatch.setattr(Q, name, value)
    got = {}
    for r in Q.candidates(index, model, queries, 11, probes=4, block=50).collect():
        got.setdefault(r.query_id, []).append((r.place, r.id))
    points = data.astype(np.float64)
    cells = model.far(points).argmin(axis=1)
    decoded = model.decoded(cells, model.codes(points, cells))
    assert len(got) == len(data)
    for q in range(len(data)):
        near = np.argsort(model.far(points[q : q + 1])[0], kind="stable")[:4]
        far = np.where(np.isin(cells, near), ((decoded - points[q]) ** 2).sum(axis=1), np.inf).round(12)
        order = [int(i) for i in np.lexsort((np.arange(len(far)), far))[:11] if np.isfinite(far[i])]
        assert len(got[q]) == len(order) and sorted(far[i] for _, i in got[q]) == pytest.approx(sorted(far[order]))


def test_unknown_numbers_hide_no_other_vector(spark):
    """a vector with a null element is near to nothing, and the others of its block are found as without it."""
    rows = [(1, [0.0, 1.0]), (2, [0.5, 1.0]), (3, [None, 1.0]), (4, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in V.knn(df, df.select(F.col("id").alias("query_id"), "embedding"), 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 2, (2, 2): 1, (4, 1): 4, (4, 2): 2}

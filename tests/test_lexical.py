"""The stored word index: runs, exactness of skipping, what is read."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import lexical as X
from skein.operators import retrieval as R

WEIGHTS = {"title": 3, "body": 1}
DOCS = "id long, title string, body string"
ASKED = "query_id long, text string"


def texts(seed, ids):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    share = [1 / (i + 1) for i in range(40)]
    out = []
    for i in ids:
        body = rnd.choices(words, share, k=rnd.randint(0, 30))
        # One document in six is all about one word, so bounds differ between blocks.
        body += [rnd.choice(words)] * 20 if i % 6 == 0 else []
        out.append((i, rnd.choice(["", None, "w3 w7", "Wörd w1"]), " ".join(body)))
    return out


def rows(found):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in found.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Three runs: a first state, changes with removals, and a document that comes back."""
    table = str(tmp_path_factory.mktemp("words") / "index")
    state = {r[0]: r for r in texts(1, range(300))}
    assert X.index_run(spark.createDataFrame(list(state.values()), DOCS), table, WEIGHTS, block_documents=8) == 0
    changed = texts(2, range(40, 90)) + texts(3, range(300, 320))
    gone = [*range(10), 85, 9_999]
    X.index_run(spark.createDataFrame(changed, DOCS), table, WEIGHTS, spark.createDataFrame([(i,) for i in gone], "id long"), block_documents=8)
    state = {i: r for i, r in state.items() if i not in gone} | {r[0]: r for r in changed}
    back = texts(4, [3, 41])
    X.index_run(spark.createDataFrame(back, DOCS), table, WEIGHTS, block_documents=8)
    return table, state | {r[0]: r for r in back}


@pytest.mark.parametrize("first_blocks", [1, 10, 1000])
def test_equals_the_plain_ranking(spark, index, first_blocks):
    table, state = index
    docs = spark.createDataFrame(list(state.values()), DOCS)
    asked = spark.createDataFrame([(1, "w0"), (2, "w5 w5 w9 word"), (3, "unknown"), (4, None), (5, " ".join(f"w{i}" for i in range(12))), (6, "w39")], ASKED)
    found, read = X.search(spark, table, asked, 5, first_blocks)
    plain = R.bm25(R.postings(docs, WEIGHTS).persist(), len(state), asked, 5)
    assert rows(found) == rows(plain)
    seen = {r.query_id: r for r in read.collect()}
    assert seen.keys() == {1, 2, 5, 6}
    assert all(r.postings_read <= r.postings and r.blocks_read <= r.blocks for r in seen.values())
    if first_blocks == 10:
        # Words in over half of the documents weigh next to nothing: all of their documents tie at six digits, and none can be left out.
        assert seen[2].postings_read < seen[2].postings and seen[2].blocks_read < seen[2].blocks, seen
    if first_blocks == 1000:
        assert all(r.postings_read == r.postings for r in seen.values())


def test_live_documents_and_counts(spark, index):
    table, state = index
    assert {r.id for r in X.live_documents(spark, table).collect()} == state.keys()
    done = X.runs(spark, table)
    assert [n for n, _ in done] == [0, 1, 2]
    totals = X._table(spark, done, "totals").agg(F.sum("documents").alias("n"), F.sum("words").alias("w")).first()
    plain = R.postings(spark.createDataFrame(list(state.values()), DOCS), WEIGHTS)
    assert (totals.n, totals.w) == (len(state), plain.agg(F.sum("n").alias("n")).first().n)
    df = {r.term: r.df for r in X._table(spark, done, "terms").groupBy("term").agg(F.sum("df").alias("df")).collect() if r.df}
    assert df == {r.term: r["count"] for r in plain.groupBy("term").count().collect()}


def test_a_run_that_died_is_not_read(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "index")
    X.index_run(spark.createDataFrame([(1, "fox", "a"), (2, "b", "c"), (3, "d", "e")], DOCS), table, WEIGHTS)
    with monkeypatch.context() as m:
        m.setattr(X, "write_snapshot", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            X.index_run(spark.createDataFrame([(4, "fox", "fox")], DOCS), table, WEIGHTS)
    asked = spark.createDataFrame([(1, "fox")], ASKED)
    assert [r.id for r in X.search(spark, table, asked, 5)[0].collect()] == [1]
    assert X.index_run(spark.createDataFrame([(5, "fox", "")], DOCS), table, WEIGHTS) == 1
    assert {r.id for r in X.search(spark, table, asked, 5)[0].collect()} == {1, 5}


def test_empty(spark, tmp_path):
    asked = spark.createDataFrame([(1, "fox")], ASKED)
    table = str(tmp_path / "index")
    X.index_run(spark.createDataFrame([], DOCS), table, WEIGHTS)
    assert X.search(spark, table, asked, 5)[0].count() == 0
    assert X.search(spark, table, asked.limit(0), 5)[0].count() == 0


def test_no_posting_becomes_a_row(spark, index):
    """Scores and bounds come from lists of postings: no plan of a search explodes them, and a query's ties over pieces hold."""
    table, state = index
    found, _ = X.search(spark, table, spark.createDataFrame([(1, "w0 w1 w2")], ASKED), 5)
    assert "Generate" not in found._jdf.queryExecution().toString()
    blocks = X._table(spark, X.runs(spark, table), "blocks")
    assert dict(blocks.dtypes)["ids"] == "array<bigint>" and blocks.where("size(ids) != n or size(wtf) != n or size(lengths) != n").count() == 0

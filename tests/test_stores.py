"""Registry, drift, snapshots, readers, governance and fidelity."""

import datetime as dt
import math
import random
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from skein.operators import fidelity as S
from skein.operators import governance as G
from skein.operators import patterns as P
from skein.operators import registry as R
from skein.sources import documents as files
from skein.sources import snapshots


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="skein-test-")


def test_identity_drift(spark):
    parsed = spark.createDataFrame([("one", "One", "p/one"), ("two", "Two", "p/two")], "skill_id string, name string, source_path string")
    vector = spark.createDataFrame([(1, "one"), (2, "stale"), (3, None)], "row_id long, skill_id string")
    governance = spark.createDataFrame(
        [("one", "one", "x", "r1", "abc"), ("orphan", "orphan", "y", None, None), ("bare", "Two", "z", "r2", None)],
        "skill_id string, name string, source_path string, current_revision_id string, source_checksum string")
    got = {(r.kind, r.subject) for r in R.identity_drift(parsed, vector, governance).collect()}
    assert got == {
        ("parsed_missing_from_vector", "two"), ("vector_missing_from_parsed", "stale"), ("vector_rows_without_skill_id", "3"),
        ("governance_missing_current_revision", "orphan"), ("governance_without_revision_checksum", "bare"), ("governance_unmatched_to_parsed", "orphan")}


@pytest.mark.parametrize("kinds, state", [
    ([], "healthy"), (["pending_projection"], "stale-derived-projection"), (["pending_projection", "authority_missing"], "authority-missing"),
    (["unknown", "authority_missing"], "unknown"),
])
def test_store_health(spark, kinds, state):
    assert R.store_health(spark.createDataFrame([(k,) for k in kinds], "kind string")).first().state == state


def revisions(spark, rows):
    return spark.createDataFrame(
        [(a, f"r-{h}", "1", "m", "1", h, p) for a, h, p in rows],
        "asset_id string, revision_id string, representation_version string, embedding_model_id string, embedding_model_version string, content_hash string, source_path string")


def test_second_index_run_changes_nothing(spark):
    two = revisions(spark, [("a", "h1", "p1"), ("b", "h2", "p2")])
    none = revisions(spark, [])
    assert tuple(R.index_report(R.index_plan(two, none)).first()) == (2, 2, 0, 0)
    assert tuple(R.index_report(R.index_plan(two, two)).first()) == (2, 0, 2, 0)
    moved = revisions(spark, [("a", "h9", "p1")])
    assert tuple(R.index_report(R.index_plan(moved, two)).first()) == (1, 1, 0, 1)


def test_only_changed_sources_are_embedded(spark, folder):
    asked = []

    def embed(rows):
        asked.append(sorted(r.source_path for r in rows.collect()))
        return rows.select("source_path", F.array(F.length("text").cast("float")).alias("embedding"))

    def run(active, texts):
        table = f"{folder}/index"
        schema = active.select(*R.INDEX_IDENTITY, F.array(F.lit(0.0).cast("float")).alias("embedding")).schema
        before = snapshots.read_snapshot(spark, table, schema)
        frame = spark.createDataFrame(texts, "source_path string, text string")
        snapshots.write_snapshot(R.reindexed(before, active, frame, embed), table)
        return {(r.source_path, r.content_hash, tuple(r.embedding)) for r in snapshots.read_snapshot(spark, table, schema).collect()}

    two = revisions(spark, [("a", "h1", "p1"), ("b", "h2", "p2")])
    want = {("p1", "h1", (3.0,)), ("p2", "h2", (4.0,))}
    assert run(two, [("p1", "one"), ("p2", "four")]) == want
    assert run(two, [("p1", "never read"), ("p2", "never read")]) == want
    moved = revisions(spark, [("b", "h9", "p2"), ("c", "h3", "p3")])
    assert run(moved, [("p2", "sixsix"), ("p3", "x")]) == {("p2", "h9", (6.0,)), ("p3", "h3", (1.0,))}
    assert asked == [["p1", "p2"], [], ["p2", "p3"]]
    with pytest.raises(Exception, match="no vector for p4"):
        run(revisions(spark, [("d", "h4", "p4")]), [("p5", "x")])


def test_identities(spark):
    rows = [("p__s__x", "One", 1), ("p__s__x", "Two", 2), ("p__s__y", "Solo", 3), ("p__s__z", "Same", 4), ("p__s__z", "same!", 5), ("p__s__w", "Y", 6), ("p__s__w", "Q", 7)]
    df = spark.createDataFrame(rows, "legacy_skill_id string, source_name string, n long")
    got = {r.n: (r.asset_id, r.state) for r in R.resolve_identities(df).collect()}
    assert got == {1: ("p__s__one", "available"), 2: ("p__s__two", "available"), 3: ("p__s__y", "available"), 4: ("p__s__z", "ambiguous"),
                   5: ("p__s__z", "ambiguous"), 6: ("p__s__y", "collision"), 7: ("p__s__q", "available")}


def test_corpus_digest_ignores_order(spark):
    df = spark.createDataFrame([(i, f"h{i}") for i in range(100)], "id long, h string")
    a = R.corpus_digest(df, ["id", "h"]).first()
    assert a == R.corpus_digest(df.orderBy(F.desc("id")).repartition(7), ["h", "id"]).first()
    assert a != R.corpus_digest(df.where("id <> 5"), ["id", "h"]).first()
    assert a != R.corpus_digest(df.withColumn("h", F.when(F.col("id") == 5, "x").otherwise(F.col("h"))), ["id", "h"]).first()


def test_canonical_digest(spark):
    import hashlib

    text = '{"a":1,"b":"é","c":null}'
    got = spark.range(1).select(R.canonical_digest({"c": F.lit(None).cast("string"), "b": F.lit("é"), "a": F.lit(1)}).alias("d")).first().d
    assert got == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_snapshot_stays_on_failure(spark, folder):
    schema = "filename string, v long"
    good = spark.createDataFrame([("a", 1)], schema)
    assert snapshots.read_snapshot(spark, folder, good.schema).count() == 0
    snapshots.write_snapshot(good, folder)
    bad = good.withColumn("v", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception):
        snapshots.write_snapshot(bad, folder)
    assert [tuple(r) for r in snapshots.read_snapshot(spark, folder, good.schema).collect()] == [("a", 1)]
    snapshots.write_snapshot(good.withColumn("v", F.lit(2).cast("long")), folder)
    assert snapshots.read_snapshot(spark, folder, good.schema).first().v == 2


def test_upsert(spark):
    store = spark.createDataFrame([], "filename string, name string, description string, category string, version string, action_count long, rule_count long, directive_count long, embedding array<float>")
    schema = "filename string, title string, name string, description string, skill_layer string, schema_version string, actions array<string>, rules array<string>, directives array<string>, embedding array<float>"
    batch = spark.createDataFrame([("f", "", "n", None, "l", "2", ["a", "b"], None, [], [0.0, 1.0])], schema)
    row = R.upserted(store, batch, 2).first()
    assert (row.name, row.description, row.action_count, row.rule_count) == ("n", "", 2, 0)
    with pytest.raises(Exception, match="embedding must have 3 values"):
        R.upserted(store, batch, 3).collect()


def test_readers(spark, folder):
    with open(os.path.join(folder, "good.json"), "w") as f:
        f.write('{"meta": {"name": "n",\n "skill_id": "x"}, "decomposition": {"actions": [{"id": "a_001"}]}}')
    with open(os.path.join(folder, "bad.json"), "w") as f:
        f.write("{nope")
    assert [(r.filename, r.meta.name) for r in files.read_documents(spark, folder).collect()] == [("good.json", "n")]
    for i in range(25):
        with open(os.path.join(folder, f"worse{i:02}.json"), "w") as f:
            f.write("[")
    with pytest.raises(files.SnapshotError, match="26 files are no documents, the first is bad.json") as error:
        files.read_documents(spark, folder, strict=True)
    assert [r.filename for r in error.value.files.collect()] == ["bad.json", *(f"worse{i:02}.json" for i in range(25))]
    os.makedirs(os.path.join(folder, "u", "v"))
    with open(os.path.join(folder, "u", "v", "a.md"), "w") as f:
        f.write("x\ny")
    corpus = files.read_text_corpus(spark, folder).collect()
    assert [(r.unit.endswith("/u/v"), r.ext, r.text) for r in corpus] == [(True, "md", "x\ny")]
    digests = files.file_digests(spark, folder, "*.md").first()
    assert digests.bytes == 3 and digests.digest.startswith("sha256:")


def test_effective_values_feed_filters(spark):
    skills = spark.createDataFrame([("s", "n", "a", "pending", "low", "r"), ("t", "m", "b", "approved", "low", None)],
                                   "skill_id string, name string, author_name string, status string, risk_level string, current_revision_id string")
    skills = skills.withColumn("updated_at", F.lit(dt.datetime(2024, 1, 1)))
    revs = spark.createDataFrame([("r", "s", "approved", None)], "revision_id string, skill_id string, status string, risk_level string")
    e = G.effective_skills(skills, revs)
    assert {r.skill_id for r in G.list_skills(e, "approved", limit=10).collect()} == {"s", "t"}
    assert {r.risk_level for r in e.collect()} == {"low"}


def test_broken_findings_are_empty(spark):
    df = spark.createDataFrame([(1, "{broken"), (2, None), (3, '[{"rule_id": "R"}]')], "id long, j string")
    assert {r.id: r.n for r in df.select("id", F.size(G.parsed_findings(F.col("j"))).alias("n")).collect()} == {1: 0, 2: 0, 3: 1}


@pytest.mark.parametrize("url, web", [("git@host.org:o/r.git", "https://host.org/o/r"), (" https://h/o/r.git ", "https://h/o/r"), ("https://h/x", "https://h/x")])
def test_https_url(spark, url, web):
    assert spark.range(1).select(G.https_url(F.lit(url)).alias("u")).first().u == web


def test_source_checksum(spark):
    import hashlib
    import json

    values = {"source_type": "github", "source_url": 'a "q"', "source_commit": None, "source_path": "é", "version": "1", "fetched_at": "", "converted_at": None}
    want = hashlib.sha256(json.dumps({k: v or "" for k, v in values.items()}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    assert df.select(G.source_checksum().alias("c")).first().c == want


def test_patterns(spark):
    rows = [(1, "action", "a"), (1, "action", "b"), (2, "action", "a"), (2, "action", "b"), (2, "action", "c"), (3, "action", None), (4, "rule", "x")]
    e = spark.createDataFrame([(d, k, f"e{i}", t, "Read it") for i, (d, k, t) in enumerate(rows)], "doc_id long, kind string, element_id string, element_type string, description string")
    pairs = P.cooccurrence(e).collect()
    assert [(r.a1, r.a2, r.docs, r.frequency) for r in pairs] == [("a", "b", 2, 0.666667)]
    assert {r.doc_id for r in P.cooccurrence_members(e, P.cooccurrence(e)).collect()} == {1, 2}
    assert {(r.doc_id, r.structure) for r in P.structure_classes(e).collect()} == {(1, "action_heavy"), (2, "action_heavy"), (3, "action_heavy"), (4, "rule_heavy")}
    assert {(r.category, r.documents) for r in P.keyword_patterns(e, 4).collect()} == {("file_operation", 4)}


@pytest.mark.parametrize("a, b, value", [([], [], 1.0), (["x"], [], 0.0), (["x", "y"], ["y", "z"], 1 / 3)])
def test_jaccard(spark, a, b, value):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert abs(df.select(S.jaccard(F.col("a"), F.col("b")).alias("j")).first().j - value) < 1e-12


def test_structure_and_metadata(spark):
    a = "# One\n## Two\n```py\nx\n```\n"
    docs = spark.createDataFrame([(1, a), (2, a), (3, "plain"), (4, "plain"), (5, "# other\n")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 3), (1, 5)], "left_id long, right_id long")
    got = {(r.left_id, r.right_id): (r.heading_similarity, r.code_block_similarity) for r in S.structure_similarity(pairs, docs).collect()}
    assert got == {(1, 2): (1.0, 1.0), (3, 4): (1.0, 1.0), (1, 3): (0.0, 0.0), (1, 5): (0.25, 0.0)}
    meta = spark.createDataFrame([(1, "---\nname: a\ndescription: b\ntriggers: c\n---\n")], "doc_id long, text string")
    row = S.metadata_completeness(meta).first()
    assert abs(row.metadata_completeness - 0.85) < 1e-12 and row.recommended_missing == "globs"


def test_fidelity(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.8, 0.85), (1.0, 1.0, 1.0, 1.0)], "semantic_similarity double, structure_similarity double, keyword_similarity double, metadata_completeness double")
    rows = S.fidelity(df).orderBy("overall_score").collect()
    assert rows[0].failed_checks == "metadata_completeness" and not rows[0].passed and abs(rows[0].overall_score - 0.87) < 1e-9
    assert rows[1].passed and rows[1].overall_score == pytest.approx(1.0)


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red fox jumps"), (3, "blue whale"), (4, "")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "left_id long, right_id long")
    got = {(r.left_id, r.right_id): r.tfidf_similarity for r in S.tfidf_similarity(pairs, docs).collect()}
    assert got[(1, 2)] == pytest.approx(1.0) and got[(1, 3)] == 0.0 and got[(3, 4)] == 0.0


def test_terms_of_pairs_are_not_shuffled(spark):
    """a pair's terms are counted in its row, and pairs, small files of many rows, are never broadcast."""
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (1, "beta gamma"), (2, "alpha beta"), (3, None), (4, "")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4), (None, 1)], "left_id long, right_id long")
    found = S.tfidf_similarity(pairs, docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("strategy=merge") == 2
    got = {(r.left_id, r.right_id): round(r.tfidf_similarity, 6) for r in found.collect()}
    # Texts of one id count together; tf of both: alpha 2 1, beta 2 1, "alpha beta" 1 1; alone on the left: gamma, "beta alpha", "beta gamma".
    own = math.log(1.5) + 1
    want = 5 / (math.sqrt(9 + 3 * own**2) * math.sqrt(3))
    assert found.count() == 5 and got == {(1, 2): round(want, 6), (2, 3): 0.0, (3, 4): 0.0, (None, 1): 0.0}


def test_a_text_is_sent_once_to_each_place(spark, monkeypatch):
    """however many pairs name a document, its words lie once where the pairs of its family meet; blocks of a large family change nothing."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 25))) for i in range(14)}
    docs = spark.createDataFrame([*texts.items(), (3, "w1 whale"), (99, "of no pair")], "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(14) for b in range(a + 1, 14)] + [(2, 2), (1, 500)], "left_id long, right_id long")
    found = S.tfidf_similarity(pairs, docs)
    got = sorted((r.left_id, r.right_id, round(r.tfidf_similarity, 9)) for r in found.collect())
    held = {i: [t.split()] for i, t in texts.items()}
    held[3].append(["w1", "whale"])
    assert got == sorted((a, b, round(S._tfidf_cosine(held[a], held[b], 10_000), 9) if b < 500 else 0.0) for a, b in (tuple(r) for r in pairs.collect()))
    assert S.placed(pairs.where("left_id < right_id and right_id < 500")).select("place").distinct().count() == 1
    monkeypatch.setattr(S, "FAMILY", 4)
    assert got == sorted((r.left_id, r.right_id, round(r.tfidf_similarity, 9)) for r in S.tfidf_similarity(pairs, docs).collect())
    assert S.placed(pairs).select("place").distinct().count() > 3

"""Registry and drift queries: assets from ``documents``, sinks and file sources over derived files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scan_values as SV
from skein.functions import text_values as V
from skein.operators import extension as X
from skein.operators import manifest
from skein.operators import patterns as P
from skein.operators import registry as R
from skein.operators import scan as S
from skein.plans import analytics
from skein.plans.corpus import scan_corpus
from skein.plans.registry import Tables, query
from skein.plans.retrieval import LETTERS, letter_profile
from skein.plans.scan import FOUND, corpus_lines, weight_sql
from skein.session import work_folder
from skein.sources import documents as files
from skein.sources import snapshots


def _path():
    return F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))


def revisions(t: Tables) -> DataFrame:
    """Assets: one revision per document; content hash over its text."""
    d = t.spread("documents")
    content = R.digest(F.col("text"))
    return d.select(
        F.concat(F.lit("claude__skill__"), F.col("source"), F.lit("_"), F.col("lang")).alias("asset_id"),
        F.concat(F.lit("asset-revision:"), content).alias("revision_id"), F.lit("1.0.0").alias("representation_version"),
        F.lit("m").alias("embedding_model_id"), F.lit("1").alias("embedding_model_version"), content.alias("content_hash"),
        _path().alias("source_path"), "doc_id", "lang", "source", F.regexp_extract("text", "^[^\\n]*", 0).alias("summary"),
    )


def index_state(t: Tables) -> DataFrame:
    """State of an older index: some documents changed, some were not there, some are gone."""
    r = revisions(t)
    old = F.when(F.col("doc_id") % 7 == 0, F.lit("sha256:old")).otherwise(F.col("content_hash"))
    gone = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("gone/"), F.col("doc_id").cast("string"))).otherwise(F.col("source_path"))
    version = F.when(F.col("doc_id") % 13 == 0, "0").otherwise(F.col("embedding_model_version"))
    return r.withColumns({"content_hash": old, "source_path": gone, "embedding_model_version": version})


ASSETS = """
WITH r AS MATERIALIZED (SELECT 'claude__skill__' || source || '_' || lang AS asset_id, 'asset-revision:sha256:' || sha256(text) AS revision_id, 'sha256:' || sha256(text) AS content_hash,
  'doc/' || doc_id AS source_path, '1' AS v, doc_id, lang, source, regexp_extract(text, '^[^\\n]*', 0) AS summary FROM documents),
st AS MATERIALIZED (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN 'sha256:old' ELSE content_hash END AS content_hash,
  CASE WHEN doc_id % 11 = 0 THEN 'gone/' || doc_id ELSE source_path END AS source_path, CASE WHEN doc_id % 13 = 0 THEN '0' ELSE v END AS v) FROM r)
"""


@query("t33_canonical_digests", """
SELECT o_orderkey, 'sha256:' || sha256('{"key":' || o_orderkey || ',"note":null,"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def _(t):
    fields = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "key": F.col("o_orderkey"), "note": F.lit(None).cast("string")}
    return t.orders.select("o_orderkey", R.canonical_digest(fields).alias("digest"))


IDENTITY = """
WITH c AS (SELECT c_custkey, 'claude__skill__' || CASE WHEN c_custkey % 3 = 0 THEN 'unique_' || c_custkey ELSE 'shared_' || (c_custkey % 300) END AS legacy_skill_id,
  CASE WHEN c_custkey % 20 = 1 THEN '!!' WHEN c_custkey % 20 = 2 THEN 'Same Name' WHEN c_custkey % 20 = 4 THEN 'Unique ' || (c_custkey - 1) ELSE c_name END AS source_name FROM customer),
n AS (SELECT *, CASE WHEN s <> '' THEN 'claude__skill__' || s END AS derived FROM (SELECT *, regexp_replace(regexp_replace(lower(source_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM c)),
g AS (SELECT legacy_skill_id, count(*) AS n, count(*) = count(derived) AND count(DISTINCT derived) = count(*) AND count(*) > 1 AS ok FROM n GROUP BY 1),
j AS (SELECT n.*, g.n, g.ok FROM n JOIN g USING (legacy_skill_id)),
sh AS (SELECT derived FROM j WHERE ok GROUP BY derived HAVING count(DISTINCT legacy_skill_id) > 1),
res AS (SELECT c_custkey, CASE WHEN ok THEN derived ELSE legacy_skill_id END AS asset_id, CASE WHEN ok THEN 'source_name_disambiguation' ELSE 'legacy_exact' END AS identity_strategy,
  CASE WHEN n = 1 THEN 'available' WHEN ok AND (derived IN (SELECT legacy_skill_id FROM g) OR derived IN (FROM sh)) THEN 'collision' WHEN ok THEN 'available' ELSE 'ambiguous' END AS state FROM j)
"""


def identities(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    legacy = F.concat(F.lit("claude__skill__"), F.when(key % 3 == 0, F.concat(F.lit("unique_"), key.cast("string")))
                      .otherwise(F.concat(F.lit("shared_"), (key % 300).cast("string"))))
    name = (F.when(key % 20 == 1, "!!").when(key % 20 == 2, "Same Name")
            .when(key % 20 == 4, F.concat(F.lit("Unique "), (key - 1).cast("string"))).otherwise(F.col("c_name")))
    return R.resolve_identities(t.customer.select("c_custkey", legacy.alias("legacy_skill_id"), name.alias("source_name")))


@query("t35_resolved_identities", IDENTITY + "SELECT * FROM res")
def _(t):
    return identities(t).select("c_custkey", "asset_id", "identity_strategy", "state")


@query("u6_listed_revisions", IDENTITY + "SELECT c_custkey, asset_id FROM res WHERE state = 'available' UNION ALL SELECT c_custkey, asset_id FROM res WHERE state = 'ambiguous'")
def _(t):
    i = identities(t)
    return i.where(F.col("state") == "available").select("c_custkey", "asset_id").unionByName(
        i.where(F.col("state") == "ambiguous").select("c_custkey", "asset_id"))


@query("t36_envelope_violations", """
WITH d AS (SELECT doc_id, 'doc/' || doc_id AS source_path FROM documents)
SELECT source_path, 'unsupported_asset_type' AS violation FROM d WHERE doc_id % 10 = 1
UNION ALL SELECT source_path, 'legacy_id_mismatch' FROM d WHERE doc_id % 10 = 2
UNION ALL SELECT source_path, 'unsupported_strategy' FROM d WHERE doc_id % 10 = 3
UNION ALL SELECT source_path, 'asset_id_mismatch' FROM d WHERE doc_id % 10 = 4
UNION ALL SELECT source_path, 'content_hash_mismatch' FROM d WHERE doc_id % 10 = 5
UNION ALL SELECT source_path, 'revision_id_mismatch' FROM d WHERE doc_id % 10 = 6
UNION ALL SELECT source_path, 'provenance_skill_mismatch' FROM d WHERE doc_id % 10 = 7""")
def _(t):
    r = revisions(t)
    k = F.col("doc_id") % 10

    def odd(n, name):
        return F.when(k == n, "bad").otherwise(F.col(name))

    d = r.join(t.documents.select("doc_id", F.col("text").alias("payload")), "doc_id")
    envelopes = d.select(
        "source_path", "payload", F.when(k == 1, "workflow").otherwise("skill").alias("asset_type"), F.col("asset_id").alias("skill_id"),
        odd(2, "asset_id").alias("legacy_skill_id"), odd(4, "asset_id").alias("asset_id"), F.lit("x").alias("source_name"),
        F.when(k == 3, "other").otherwise(R.LEGACY).alias("identity_strategy"), odd(5, "content_hash").alias("content_hash"),
        odd(6, "revision_id").alias("revision_id"), odd(7, "asset_id").alias("provenance_skill_id"))
    return R.envelope_violations(envelopes)


@query("a28_asset_summaries", ASSETS + """
SELECT asset_id, count(*) AS revision_count, count(*) > 1 AS ambiguous, arg_min(source, source_path) AS name, arg_min(summary, source_path) AS summary FROM r GROUP BY asset_id""")
def _(t):
    return R.asset_summaries(revisions(t).withColumn("name", F.col("source")))


MANIFEST = ["doc_id", "text", "lang", "source"]
LEAF = "sha256(" + " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in MANIFEST) + ")"


@query("a29_manifest", f"""
WITH leaf AS (SELECT leaf, count(*) AS n FROM (SELECT {LEAF} AS leaf FROM documents) GROUP BY leaf),
n2 AS (SELECT leaf[1:2] AS prefix, sha256(string_agg(leaf || '*' || n, ',' ORDER BY leaf || '*' || n)) AS digest, sum(n)::BIGINT AS "rows" FROM leaf GROUP BY 1),
n1 AS (SELECT prefix[1:1] AS prefix, sha256(string_agg(prefix || '=' || digest, ',' ORDER BY prefix)) AS digest, sum("rows")::BIGINT AS "rows" FROM n2 GROUP BY 1),
n0 AS (SELECT '' AS prefix, sha256(string_agg(prefix || '=' || digest, ',' ORDER BY prefix)) AS digest, sum("rows")::BIGINT AS "rows" FROM n1)
SELECT 0 AS depth, * FROM n0 UNION ALL SELECT 1, * FROM n1 UNION ALL SELECT 2, * FROM n2""")
def _(t):
    return manifest.manifest(t.documents, MANIFEST, 2)


@query("a29_manifest_changes", """
SELECT doc_id, text, lang, source, 1::BIGINT AS n_before, 0::BIGINT AS n_after FROM documents WHERE doc_id % 97 IN (0, 1)
UNION ALL SELECT doc_id, text || '!', lang, source, 0, 1 FROM documents WHERE doc_id % 97 = 0
UNION ALL SELECT doc_id, text, lang, source, 1, 2 FROM documents WHERE doc_id % 97 = 2""")
def _(t):
    """Documents before and after an edit that changes some, drops some and repeats some."""
    before, part = t.documents.select(*MANIFEST), F.col("doc_id") % 97
    edited = before.withColumn("text", F.when(part == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).where(part != 1)
    after = edited.unionByName(before.where(part == 2))
    a, b = (snapshots.stored(manifest.manifest(d, MANIFEST), "manifest") for d in (before, after))
    return manifest.changed_rows(before, after, MANIFEST, manifest.changed_buckets(a, b))


@query("a29_corpus_digest", """
WITH x AS (SELECT sha256('{"content_hash":"sha256:' || sha256(text) || '","source_path":"doc/' || doc_id || '"}') AS leaf FROM documents),
s AS (SELECT count(*) AS n, sum(('0x' || substr(leaf, 1, 15))::HUGEINT) AS a, sum(('0x' || substr(leaf, 16, 15))::HUGEINT) AS b,
  sum(('0x' || substr(leaf, 31, 15))::HUGEINT) AS c, sum(('0x' || substr(leaf, 46, 15))::HUGEINT) AS d FROM x)
SELECT 'sha256:' || sha256(concat_ws(':', n, a, b, c, d)) AS snapshot_id, n AS revisions FROM s""")
def _(t):
    return R.corpus_digest(revisions(t), ["source_path", "content_hash"])


@query("j8_identity_drift", """
WITH p AS (SELECT 's' || doc_id AS skill_id, 'Doc_' || doc_id AS name, 'doc/' || doc_id AS source_path FROM documents WHERE doc_id % 5 <> 0),
v AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 17 <> 0 THEN 's' || doc_id END AS skill_id FROM documents WHERE doc_id % 3 <> 0),
g AS (SELECT 's' || doc_id AS skill_id, ' doc-' || (doc_id + CASE WHEN doc_id % 4 = 0 THEN 1000000 ELSE 0 END) || ' ' AS name,
  CASE WHEN doc_id % 8 = 0 THEN 'else/' || doc_id ELSE 'doc/' || doc_id END AS source_path, CASE WHEN doc_id % 9 <> 0 THEN 'r' END AS rev, CASE WHEN doc_id % 6 <> 0 THEN 'c' ELSE '' END AS chk FROM documents)
SELECT 'parsed_missing_from_vector' AS kind, skill_id AS subject FROM p WHERE skill_id NOT IN (SELECT skill_id FROM v WHERE skill_id IS NOT NULL)
UNION ALL SELECT 'vector_missing_from_parsed', skill_id FROM v WHERE skill_id NOT IN (SELECT skill_id FROM p)
UNION ALL SELECT 'vector_rows_without_skill_id', row_id::VARCHAR FROM v WHERE skill_id IS NULL
UNION ALL SELECT 'governance_missing_current_revision', skill_id FROM g WHERE rev IS NULL
UNION ALL SELECT 'governance_without_revision_checksum', skill_id FROM g WHERE rev IS NOT NULL AND chk = ''
UNION ALL SELECT 'governance_unmatched_to_parsed', skill_id FROM g WHERE replace(lower(trim(name)), '_', '-') NOT IN (SELECT replace(lower(name), '_', '-') FROM p) AND source_path NOT IN (SELECT source_path FROM p)""")
def _(t):
    d, k = t.documents, F.col("doc_id")
    ident = F.concat(F.lit("s"), k.cast("string"))
    parsed = d.where(k % 5 != 0).select(ident.alias("skill_id"), F.concat(F.lit("Doc_"), k.cast("string")).alias("name"), _path().alias("source_path"))
    vector = d.where(k % 3 != 0).select(k.alias("row_id"), F.when(k % 17 != 0, ident).alias("skill_id"))
    shifted = k + F.when(k % 4 == 0, 1000000).otherwise(0)
    governance = d.select(
        ident.alias("skill_id"), F.concat(F.lit(" doc-"), shifted.cast("string"), F.lit(" ")).alias("name"),
        F.when(k % 8 == 0, F.concat(F.lit("else/"), k.cast("string"))).otherwise(_path()).alias("source_path"),
        F.when(k % 9 != 0, "r").alias("current_revision_id"), F.when(k % 6 != 0, "c").otherwise("").alias("source_checksum"))
    return R.identity_drift(parsed, vector, governance)


INDEX_DRIFT = """
drift AS (SELECT coalesce(r.source_path, st.source_path) AS source_path, CASE WHEN st.source_path IS NULL THEN 'pending_projection' WHEN r.source_path IS NULL THEN 'source_removed' ELSE 'identity_mismatch' END AS finding
FROM r FULL JOIN st ON r.source_path = st.source_path WHERE r.source_path IS NULL OR st.source_path IS NULL OR r.content_hash <> st.content_hash)
"""


@query("j9_index_drift", ASSETS + "," + INDEX_DRIFT + "SELECT * FROM drift")
def _(t):
    return R.index_drift(revisions(t), index_state(t))


@query("a32_model_drift", ASSETS + "SELECT 'm' AS embedding_model_id, v AS embedding_model_version, count(*) AS rows FROM st GROUP BY v")
def _(t):
    return R.model_drift(index_state(t))


@query("j10_authority_findings", """
SELECT asset_id, reason FROM (SELECT 'a' || o_orderkey AS asset_id, CASE WHEN o_orderkey % 10 = 0 THEN 'binding_missing' WHEN o_orderkey % 9 = 0 THEN 'current_revision_missing'
  WHEN o_orderstatus <> 'F' OR o_orderkey % 8 = 0 THEN 'revision_not_approved_current' WHEN o_orderkey % 7 = 0 THEN 'artifact_digest_mismatch' END AS reason FROM orders) WHERE reason IS NOT NULL""")
def _(t):
    k = F.col("o_orderkey")
    asset = F.concat(F.lit("a"), k.cast("string"))
    o = t.orders
    rev = o.select(asset.alias("asset_id"), F.sha2(k.cast("string"), 256).alias("content_hash"))
    skills = o.where(k % 10 != 0).select(asset.alias("canonical_skill_id"), asset.alias("skill_id"), F.concat(F.lit("r"), k.cast("string")).alias("current_revision_id"))
    gov = o.where(k % 9 != 0).select(
        F.concat(F.lit("r"), k.cast("string")).alias("revision_id"), asset.alias("skill_id"),
        F.when(k % 7 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("artifact_digest"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), (k % 8 != 0).alias("is_current"))
    return R.authority_findings(rev, skills, gov)


NAMES = """
WITH g AS (SELECT DISTINCT lower(c_name) AS name FROM customer WHERE c_custkey % 3 <> 0), p AS (SELECT DISTINCT lower(upper(c_name)) AS name FROM customer WHERE c_custkey % 4 <> 0)
"""


@query("j11_name_coverage", NAMES + """
SELECT coalesce(g.name, p.name) AS name, CASE WHEN g.name IS NULL THEN 'parsed_only' WHEN p.name IS NULL THEN 'governance_only' ELSE 'in_both' END AS coverage FROM g FULL JOIN p ON g.name = p.name""")
def _(t):
    c = t.customer
    return R.name_coverage(c.where(F.col("c_custkey") % 3 != 0).select(F.col("c_name").alias("name")),
                           c.where(F.col("c_custkey") % 4 != 0).select(F.upper("c_name").alias("name")))


@query("u3_shared_names", NAMES + "SELECT name FROM g INTERSECT SELECT name FROM p")
def _(t):
    c = t.customer
    return c.where(F.col("c_custkey") % 3 != 0).select(F.lower("c_name").alias("name")).intersect(
        c.where(F.col("c_custkey") % 4 != 0).select(F.lower("c_name").alias("name")))


@query("u2_set_differences", ASSETS + """
SELECT source_path, 'left_only' AS side FROM (SELECT source_path FROM r EXCEPT SELECT source_path FROM st)
UNION ALL SELECT source_path, 'right_only' FROM (SELECT source_path FROM st EXCEPT SELECT source_path FROM r)""")
def _(t):
    return R.set_differences(revisions(t).select("source_path"), index_state(t).select("source_path"))


@query("u4_removed_sources", ASSETS + "SELECT DISTINCT source_path FROM st WHERE source_path NOT IN (SELECT source_path FROM r)")
def _(t):
    return R.removed_sources(index_state(t), revisions(t))


@query("u5_multiset_difference", """
WITH a AS (SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
c AS (SELECT l_returnflag, l_linenumber, sum(x)::BIGINT AS s FROM (SELECT *, 1 AS x FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL)
SELECT l_returnflag, l_linenumber, abs(s) AS surplus, CASE WHEN s > 0 THEN 'missing' ELSE 'extra' END AS side FROM c WHERE s <> 0""")
def _(t):
    li = t.lineitem
    cols = ["l_returnflag", "l_linenumber"]
    return R.multiset_difference(li.where(F.col("l_linestatus") == "O").select(*cols), li.where(F.col("l_linestatus") == "F").select(*cols))


@query("u7_type_sets", """
WITH e AS (SELECT unnest(['io_read', 'io_write', 'transform', 'external_call', 'await_input']) AS t),
f AS (SELECT l_orderkey AS doc_id, list_distinct(list(['transform', 'io_read', 'io_write', 'compute', 'external_call', 'state_change', 'llm_inference', 'await_input', 'unknown'][l_suppkey % 9 + 1])) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT doc_id, (SELECT string_agg(t, ',' ORDER BY t) FROM e WHERE NOT list_contains(s, t)) AS missing, (SELECT string_agg(t, ',' ORDER BY t) FROM e WHERE list_contains(s, t)) AS shared FROM f""")
def _(t):
    expected = F.array(*[F.lit(x) for x in V.EXPECTED_ACTION_TYPES])
    joined = lambda c: F.nullif(F.array_join(F.sort_array(c), ","), F.lit(""))
    return P.type_sets(analytics.elements(t)).select(
        "doc_id", joined(F.array_except(expected, "types")).alias("missing"), joined(F.array_intersect(expected, "types")).alias("shared"))


@query("j17_manifest_status", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'pending' WHEN p_size % 7 = 0 THEN 'checksum_drift' ELSE 'applied' END AS status FROM part""")
def _(t):
    p = t.part
    declared = p.select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("checksum"))
    applied = p.where(F.col("p_partkey") % 5 != 0).select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 == 0, "x").otherwise(F.md5("p_name")).alias("checksum"))
    return R.manifest_status(declared, applied)


@query("a33_store_health", ASSETS + "," + INDEX_DRIFT + """
SELECT 'stale-derived-projection' AS state, (SELECT count(*) FROM drift) + (SELECT count(DISTINCT v) FROM st) AS findings""")
def _(t):
    drift = R.index_drift(revisions(t), index_state(t)).select(
        F.when(F.col("finding") == "pending_projection", "pending_projection").otherwise("stale_index_identity").alias("kind"))
    return R.store_health(drift.unionByName(R.model_drift(index_state(t)).select(F.lit("model_version_drift").alias("kind"))))


PLAN = """
plan AS (SELECT r.source_path, CASE WHEN st.source_path IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS plan FROM r LEFT JOIN st ON st.source_path = r.source_path AND st.content_hash = r.content_hash AND st.v = r.v
  UNION ALL SELECT DISTINCT source_path, 'removed' FROM st WHERE source_path NOT IN (SELECT source_path FROM r))
"""


@query("v9_index_plan", ASSETS + "," + PLAN + "SELECT * FROM plan")
def _(t):
    return R.index_plan(revisions(t), index_state(t))


@query("v9_index_report", ASSETS + "," + PLAN + """
SELECT count_if(plan <> 'removed')::BIGINT AS total, count_if(plan = 'changed')::BIGINT AS changed, count_if(plan = 'unchanged')::BIGINT AS unchanged, count_if(plan = 'removed')::BIGINT AS removed FROM plan""")
def _(t):
    return R.index_report(R.index_plan(revisions(t), index_state(t)))


def indexed_snapshot(t: Tables) -> DataFrame:
    """The older index with vectors, then brought up to date: only texts of changed sources are embedded."""
    table = work_folder(t.spark, "index")
    before, active = index_state(t), revisions(t)
    texts = t.spread("documents").select(_path().alias("source_path"), "text")

    def embed(rows: DataFrame) -> DataFrame:
        return rows.select("source_path", letter_profile(F.col("text")).alias("embedding"))

    old = t.spread("documents").select("doc_id", letter_profile(F.col("text")).alias("embedding"))
    # The vectors of changed content are those of another text.
    vector = F.when(F.col("content_hash") == "sha256:old", F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    start = before.join(old, "doc_id").select(*R.INDEX_IDENTITY, vector.alias("embedding"))
    schema = start.schema
    snapshots.write_snapshot(start, table)
    snapshots.write_snapshot(R.reindexed(snapshots.read_snapshot(t.spark, table, schema), active, texts, embed), table)
    return snapshots.read_snapshot(t.spark, table, schema)


@query("v10_reconciled_snapshot", ASSETS + "SELECT source_path, content_hash, v AS embedding_model_version FROM r")
def _(t):
    return indexed_snapshot(t).select("source_path", "content_hash", "embedding_model_version")


@query("v10_snapshot_vectors", ASSETS + f"""
SELECT source_path, round(u.share, 6)::DOUBLE AS share, u.letter FROM (
  SELECT 'doc/' || doc_id AS source_path, unnest([{{'letter': c, 'share': (length(lower(text)) - length(replace(lower(text), c, ''))) / greatest(length(text), 1)}} for c in {list(LETTERS)!r}]) AS u FROM documents)""")
def _(t):
    """The vector of every source, a row per letter."""
    letters = F.array(*[F.lit(c) for c in LETTERS])
    pairs = F.explode(F.arrays_zip(letters.alias("letter"), F.col("embedding").alias("share"))).alias("u")
    return indexed_snapshot(t).select("source_path", pairs).select("source_path", F.round(F.col("u.share").cast("double"), 6).alias("share"), F.col("u.letter").alias("letter"))


@query("s8_upserted_documents", """
SELECT 'v' || vec_id || '.json' AS filename, CASE WHEN vec_id % 3 = 0 THEN 'new ' || vec_id ELSE 'old' END AS name, 64::BIGINT AS dimension FROM embeddings""")
def _(t):
    e = t.embeddings
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".json"))
    empty = F.array().cast("array<string>")

    def rows(df, title):
        return df.select(name.alias("filename"), title.alias("title"), F.lit("n").alias("name"), F.lit("d").alias("description"), F.lit("l").alias("skill_layer"),
                         F.lit("2").alias("schema_version"), empty.alias("actions"), empty.alias("rules"), empty.alias("directives"), "embedding")

    table = work_folder(t.spark, "vector-store")
    empty_store = R.upserted(t.spark.createDataFrame([], (
        "filename string, name string, description string, category string, version string, action_count long, rule_count long, directive_count long, embedding array<float>"
    )), rows(e, F.lit("old")), 64)
    snapshots.write_snapshot(empty_store, table)
    before = snapshots.read_snapshot(t.spark, table, empty_store.schema)
    batch = rows(e.where(F.col("vec_id") % 3 == 0), F.concat(F.lit("new "), F.col("vec_id").cast("string")))
    snapshots.write_snapshot(R.upserted(before, batch, 64), table)
    return snapshots.read_snapshot(t.spark, table, empty_store.schema).select("filename", "name", F.size("embedding").cast("long").alias("dimension"))


@query("s9_appended_events", "SELECT strftime(ts, '%Y-%m-%d') AS occurred_on, count(*) AS events FROM events GROUP BY 1")
def _(t):
    table = work_folder(t.spark, "event-log")
    e = t.events.withColumn("occurred_on", F.date_format("ts", "yyyy-MM-dd"))
    snapshots.append_events(e.where(F.col("user_id") % 2 == 0), table)
    snapshots.append_events(e.where(F.col("user_id") % 2 == 1), table)
    log = t.spark.read.schema(e.schema).parquet(table)
    return log.groupBy("occurred_on").agg(F.count(F.lit(1)).alias("events"))


@query("s10_pattern_report", analytics.EL + analytics.PAIRS + """
SELECT 'pat_act_' || a1 || '_' || a2 AS pattern_id, round(docs / (SELECT count(DISTINCT doc_id) FROM ty), 3) AS frequency FROM pairs WHERE docs >= 2""")
def _(t):
    path = work_folder(t.spark, "pattern-report")
    files.write_report(P.cooccurrence(analytics.elements(t)), path)
    return t.spark.read.schema("pattern_id string, frequency double").json(path)


@query("s11_scan_reports", FOUND + f"""
, s AS (SELECT unit, count(*) AS n FROM found GROUP BY unit)
SELECT unit, coalesce(n, 0) AS findings FROM (SELECT DISTINCT unit FROM corpus) LEFT JOIN s USING (unit)""")
def _(t):
    found = snapshots.stored(S.scan_lines(corpus_lines(t, SV.LINE_RULES), SV.LINE_RULES), "findings")
    reports = files.scan_reports(S.scan_units(scan_corpus(t).select("unit", "path"), found), found, 100)
    n = F.when(F.col("page") == 0, F.lit(0)).otherwise(F.json_array_length("report"))
    return reports.groupBy("unit").agg(F.sum(n).cast("long").alias("findings"))


@query("s1_read_documents", "SELECT c_custkey, c_name AS name, (c_custkey % 4)::BIGINT AS actions FROM customer WHERE c_custkey % 10 <> 0")
def _(t):
    """Documents written as JSON lines, one in ten without its parts, and read back by the tolerant reader."""
    folder = work_folder(t.spark, "documents")
    key = F.col("c_custkey")
    whole = key % 10 != 0
    action = F.struct(F.lit("a_001").alias("id"), F.lit("x").alias("name"))
    t.customer.select(
        F.when(whole, F.struct(key.cast("string").alias("skill_id"), F.col("c_name").alias("name"))).alias("meta"),
        F.when(whole, F.struct(F.array_repeat(action, (key % 4).cast("int")).alias("actions"))).alias("decomposition"),
        F.when(~whole, "broken").alias("other"),
    ).write.json(folder)
    found = files.read_documents(t.spark, folder, multiline=False)
    return found.select(F.col("meta.skill_id").cast("long").alias("c_custkey"), "meta.name", F.size("decomposition.actions").cast("long").alias("actions"))


def text_folder(t: Tables) -> str:
    """The documents as text files by source."""
    folder = work_folder(t.spark, "texts")
    d = t.documents.select("source", "text").repartition("source")
    d.write.partitionBy("source").option("maxRecordsPerFile", 100).text(folder)
    return folder


@query("s2_text_corpus", "SELECT source AS unit, 'txt' AS ext, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY source")
def _(t):
    corpus = files.read_text_corpus(t.spark, text_folder(t))
    lines = F.size(F.split("text", "\n", -1)) - 1
    return corpus.groupBy(F.regexp_extract("unit", "source=([^/]*)$", 1).alias("unit"), "ext").agg(F.sum(lines).alias("lines"))


@query("s4_file_digests", "SELECT sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, true AS digests FROM documents")
def _(t):
    d = files.file_digests(t.spark, text_folder(t), "*.txt")
    return d.agg(F.sum("bytes").alias("bytes"), F.bool_and(F.col("digest").rlike("^sha256:[0-9a-f]{64}$")).alias("digests"))


@query("x2_rule_evaluator", """
SELECT o_orderkey, 'r_001' AS rule_id, o_totalprice > 100000 AS passed FROM orders UNION ALL SELECT o_orderkey, 'r_002', o_orderstatus = 'F' AND o_orderpriority LIKE '1%' FROM orders""")
def _(t):
    return X.evaluate_rules(t.orders, {"r_001": "o_totalprice > 100000", "r_002": "o_orderstatus = 'F' AND o_orderpriority LIKE '1%'"}, ["o_orderkey"])


@query("x3_custom_policy", "SELECT o_orderkey AS binding_id, CASE WHEN o_orderstatus = 'F' THEN 'allow' ELSE 'deny' END AS decision, 'status ' || o_orderstatus AS reason FROM orders")
def _(t):
    def by_status(df: DataFrame) -> DataFrame:
        return df.select("binding_id", F.when(F.col("status") == "F", "allow").otherwise("deny").alias("decision"),
                         F.concat(F.lit("status "), F.col("status")).alias("reason"))

    return X.apply_policy(t.orders.select(F.col("o_orderkey").alias("binding_id"), F.col("o_orderstatus").alias("status")), by_status)


@query("x5_reusable_score", FOUND + f"""
SELECT path, least(sum(trunc({weight_sql('severity', SV.LINE_WEIGHTS)} * (1 + log2(n) * 0.5))), 100)::BIGINT AS risk_score
FROM (SELECT path, rule_id, any_value(severity) AS severity, count(*) AS n FROM found GROUP BY path, rule_id) GROUP BY path""")
def _(t):
    found = S.scan_lines(corpus_lines(t, SV.LINE_RULES), SV.LINE_RULES)
    scores = S.rule_scores(found, ["path"], "severity", ["line_no", "pattern_idx"], SV.LINE_WEIGHTS, SV.LINE_FACTOR, 5)
    return S.total_score(scores, ["path"])


@query("x6_repository_reader", ASSETS + "SELECT asset_id, revision_id, content_hash, source_path FROM r")
def _(t):
    return X.revisions_from(lambda: revisions(t), ("asset_id", "revision_id", "content_hash", "source_path"))

"""Governance queries: skills are customers, revisions and scans are orders, job items are order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import governance_values as V
from skein.operators import governance as G
from skein.operators.skew import most_common, numbered
from skein.plans.registry import Tables, query

def day(at: str, key: str):
    """Bucket in (time, key) order: a day, cut by ranges of the key."""
    return F.struct(F.date_trunc("day", at), F.floor(F.col(key) / 1_000_000))


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def revisions(t: Tables) -> DataFrame:
    o = t.orders
    key = F.col("o_orderkey")
    base = o.select(
        F.concat(F.lit("r"), key.cast("string")).alias("revision_id"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("skill_id"),
        F.when(key % 9 != 0, F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected")
               .otherwise("pending")).alias("status"),
        F.when(key % 7 != 0, _pick(["critical", "high", "medium", "low", "safe"],
                                   F.substring("o_orderpriority", 1, 1).cast("int") - 1)).alias("risk_level"),
        F.when(key % 7 != 0, F.col("o_totalprice").cast("long") % 101).alias("risk_score"),
        F.when(key % 5 != 0, F.concat(F.lit("src/"), key.cast("string"))).alias("source_path"),
        F.when(key % 6 != 0, F.sha2(key.cast("string"), 256)).alias("artifact_digest"),
        F.when(F.col("o_orderstatus") == "F", "reviewer").alias("approved_by"),
        F.col("o_orderdate").alias("updated_at"),
        key.alias("order_key"),
    )
    n = numbered(base, ["skill_id"], ["updated_at", "order_key"], day("updated_at", "order_key"), "revision_number")
    newest = o.groupBy(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("skill_id")).agg(
        F.count(F.lit(1)).alias("newest")
    )
    return n.join(newest, "skill_id").withColumn("is_current", F.col("revision_number") == F.col("newest")).drop("newest")


def current_ids(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order")
    )


def skills(t: Tables) -> DataFrame:
    c = t.customer.join(current_ids(t), "c_custkey", "left")
    key, money = F.col("c_custkey"), F.col("c_acctbal")
    return c.select(
        F.concat(F.lit("s"), key.cast("string")).alias("skill_id"),
        F.when(key % 10 != 0, F.concat(F.lit("c"), (key % 1400).cast("string"))).alias("canonical_skill_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("author_name"),
        F.when(money < 0, "blocked").when(money < 2500, "pending").when(money < 7500, "approved").otherwise("rejected").alias("status"),
        F.when(key % 4 != 0, _pick(V.RISK_LEVELS, key % 6)).alias("risk_level"),
        (F.abs(money).cast("long") % 101).alias("risk_score"),
        F.when(F.col("c_nationkey") != 0, F.round(money / 10000, 4)).alias("equivalence_score"),
        F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("skills/"), F.col("c_name"))).alias("source_path"),
        F.when(F.col("c_nationkey") % 7 != 0, F.concat(F.lit("installed/"), F.col("c_name"))).alias("installed_path"),
        F.lit("1995-01-01").cast("timestamp_ntz").alias("updated_at"),
        F.when(key % 50 != 0, F.concat(F.lit("r"), F.col("last_order").cast("string"))).alias("current_revision_id"),
    )


def effective(t: Tables) -> DataFrame:
    return G.effective_skills(skills(t), revisions(t))


def scans(t: Tables) -> DataFrame:
    o = t.orders
    key = F.col("o_orderkey")
    json = F.format_string(
        '[{"rule_id": "SEC00%d", "severity": "%s", "line_number": %d}, {"rule_id": "SEC00%d", "rule_name": "Rule %d", '
        '"severity": "low", "adjusted_severity": "info", "severity_changed": true, "in_code_block": true, "file_path": "a.md"}, {"severity": "high"}]',
        key % 9 + 1, F.lower(F.substring("o_orderpriority", 3, 3)), key % 100, F.col("o_custkey") % 9 + 1, key % 3,
    )
    return o.select(
        key.alias("scan_id"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("skill_id"),
        F.col("o_orderdate").alias("scanned_at"),
        _pick(["critical", "high", "medium", "low", "safe"], F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("risk_level"),
        (F.col("o_totalprice").cast("long") % 101).alias("risk_score"),
        (F.col("o_orderstatus") != "P").alias("succeeded"),
        F.when(key % 17 == 0, "{broken").when(key % 19 != 0, json).alias("findings_json"),
    )


ITEM_ERRORS = ["PATH_NOT_FOUND", "INSTALLED_PATH_MISSING", "TIMEOUT", ""]


def job_items(t: Tables) -> DataFrame:
    li = t.lineitem
    n = F.col("l_linenumber")
    status = (
        F.when((F.col("l_linestatus") == "O") & (F.col("l_orderkey") % 3 == 0),
               _pick(["queued", "running", "retrying"], F.col("l_partkey") % 3))
        .when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "succeeded")
        .otherwise(_pick(["succeeded", "skipped", "cancelled"], F.col("l_partkey") % 3))
    )
    items = li.withColumn("status", status)
    ship = F.col("l_shipdate")
    return items.select(
        F.col("l_orderkey").alias("job_id"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + n).alias("item_id"), "status",
        F.when(F.col("status") == "failed", _pick(ITEM_ERRORS, F.col("l_suppkey") % 4)).alias("error_code"),
        F.when(F.col("status") == "running", F.concat(F.lit("w"), (F.col("l_suppkey") % 3).cast("string"))).alias("claimed_by"),
        F.when(n != 4, ship + F.make_dt_interval(mins=F.lit(10))).alias("lease_expires_at"),
        F.when(F.col("status") != "queued", ship).alias("started_at"),
        F.when(F.col("status").isin("succeeded", "failed"), ship + F.make_dt_interval(hours=F.lit(1))).alias("completed_at"),
        ship.alias("created_at"),
    )


REV = """
rev AS (
  SELECT 'r' || o_orderkey AS revision_id, 's' || o_custkey AS skill_id,
    CASE WHEN o_orderkey % 9 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'pending' END END AS status,
    CASE WHEN o_orderkey % 7 <> 0 THEN ['critical','high','medium','low','safe'][left(o_orderpriority, 1)::INT] END AS risk_level,
    CASE WHEN o_orderkey % 7 <> 0 THEN trunc(o_totalprice)::BIGINT % 101 END AS risk_score,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'src/' || o_orderkey END AS source_path,
    CASE WHEN o_orderkey % 6 <> 0 THEN sha256(o_orderkey::VARCHAR) END AS artifact_digest,
    CASE WHEN o_orderstatus = 'F' THEN 'reviewer' END AS approved_by, o_orderdate AS updated_at, o_orderkey AS order_key,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS revision_number,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current
  FROM orders)
"""
STORE = f"""
WITH {REV},
sk AS (
  SELECT 's' || c_custkey AS skill_id, CASE WHEN c_custkey % 10 <> 0 THEN 'c' || (c_custkey % 1400) END AS canonical_skill_id,
    c_name AS name, c_mktsegment AS author_name,
    CASE WHEN c_acctbal < 0 THEN 'blocked' WHEN c_acctbal < 2500 THEN 'pending' WHEN c_acctbal < 7500 THEN 'approved' ELSE 'rejected' END AS status,
    CASE WHEN c_custkey % 4 <> 0 THEN ['safe','low','medium','high','critical','blocked'][c_custkey % 6 + 1] END AS risk_level,
    trunc(abs(c_acctbal))::BIGINT % 101 AS risk_score,
    CASE WHEN c_nationkey <> 0 THEN round(c_acctbal / 10000, 4) END AS equivalence_score,
    CASE WHEN c_nationkey % 5 <> 0 THEN 'skills/' || c_name END AS source_path,
    CASE WHEN c_nationkey % 7 <> 0 THEN 'installed/' || c_name END AS installed_path,
    TIMESTAMP '1995-01-01' AS updated_at,
    CASE WHEN c_custkey % 50 <> 0 THEN (SELECT revision_id FROM rev WHERE is_current AND skill_id = 's' || c_custkey) END AS current_revision_id
  FROM customer),
eff AS (
  SELECT sk.skill_id, canonical_skill_id, name, author_name, coalesce(r.status, sk.status) AS status,
    coalesce(r.risk_level, sk.risk_level) AS risk_level, coalesce(r.risk_score, sk.risk_score) AS risk_score, equivalence_score,
    coalesce(r.source_path, sk.source_path) AS source_path, installed_path, coalesce(r.updated_at, sk.updated_at) AS updated_at,
    current_revision_id, r.revision_id, r.revision_number, r.artifact_digest
  FROM sk LEFT JOIN rev r ON r.revision_id = sk.current_revision_id)
"""
SCANS = """
scans AS (
  SELECT o_orderkey AS scan_id, 's' || o_custkey AS skill_id, o_orderdate AS scanned_at,
    ['critical','high','medium','low','safe'][left(o_orderpriority, 1)::INT] AS risk_level,
    trunc(o_totalprice)::BIGINT % 101 AS risk_score, o_orderstatus <> 'P' AS succeeded, o_orderkey, o_custkey, o_orderpriority
  FROM orders),
found AS (
  SELECT scan_id, skill_id, scanned_at, 0::BIGINT AS position, 'SEC00' || (o_orderkey % 9 + 1) AS rule_id, NULL AS rule_name,
    lower(substr(o_orderpriority, 3, 3)) AS severity, NULL AS adjusted, o_orderkey % 100 AS line_number, '' AS file_path, false AS changed
  FROM scans WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0
  UNION ALL SELECT scan_id, skill_id, scanned_at, 1, 'SEC00' || (o_custkey % 9 + 1), 'Rule ' || (o_orderkey % 3), 'low', 'info', 0, 'a.md', true
  FROM scans WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0
  UNION ALL SELECT scan_id, skill_id, scanned_at, 2, 'unknown', NULL, 'high', NULL, 0, '', false
  FROM scans WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0)
"""
ITEMS = """
items AS (
  SELECT *, CASE WHEN status = 'failed' THEN ['PATH_NOT_FOUND','INSTALLED_PATH_MISSING','TIMEOUT',''][l_suppkey % 4 + 1] END AS error_code,
    CASE WHEN status = 'running' THEN 'w' || (l_suppkey % 3) END AS claimed_by,
    CASE WHEN l_linenumber <> 4 THEN l_shipdate + INTERVAL 10 MINUTE END AS lease_expires_at,
    CASE WHEN status <> 'queued' THEN l_shipdate END AS started_at,
    CASE WHEN status IN ('succeeded','failed') THEN l_shipdate + INTERVAL 1 HOUR END AS completed_at, l_shipdate AS created_at
  FROM (SELECT *, l_orderkey AS job_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS item_id,
    CASE WHEN l_linestatus = 'O' AND l_orderkey % 3 = 0 THEN ['queued','running','retrying'][l_partkey % 3 + 1]
      WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded'
      ELSE ['succeeded','skipped','cancelled'][l_partkey % 3 + 1] END AS status FROM lineitem))
"""
TS = "'%Y-%m-%d %H:%M:%S'"
SECONDS = "yyyy-MM-dd HH:mm:ss"


@query("s5_governance_scan", """
SELECT 'skills' AS store, count(*) AS rows FROM customer UNION ALL SELECT 'skill_revisions', count(*) FROM orders
UNION ALL SELECT 'security_scans', count(*) FROM orders UNION ALL SELECT 'action_job_items', count(*) FROM lineitem
UNION ALL SELECT 'audit_log', count(*) FROM events""")
def _(t):
    stores = {"skills": skills(t), "skill_revisions": revisions(t), "security_scans": scans(t),
              "action_job_items": job_items(t), "audit_log": t.events}
    out = None
    for name, df in stores.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("store"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


EFF_COLS = ["skill_id", "status", "risk_level", "risk_score", "source_path", "revision_number", "artifact_digest"]


@query("p1_effective_skills", STORE + f"SELECT {', '.join(EFF_COLS)}, strftime(updated_at, {TS}) AS updated_at FROM eff")
def _(t):
    return effective(t).select(*EFF_COLS, F.date_format("updated_at", SECONDS).alias("updated_at"))


@query("p2_list_skills", STORE + """
SELECT skill_id, name, status, risk_level FROM eff WHERE status = 'approved' AND risk_level = 'high'
ORDER BY updated_at DESC, skill_id LIMIT 100""")
def _(t):
    return G.list_skills(effective(t), "approved", "high", limit=100).select("skill_id", "name", "status", "risk_level")


@query("p3_dashboard_page", STORE + """
SELECT skill_id, name, author_name, risk_score FROM eff WHERE contains(lower(name), 'build') OR contains(lower(author_name), 'build')
ORDER BY risk_score DESC, skill_id LIMIT 20 OFFSET 20""")
def _(t):
    return G.dashboard_page(effective(t), "Build", "risk_score", True, 2, 20).select("skill_id", "name", "author_name", "risk_score")


@query("p3_dashboard_total", STORE + """
SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM eff
WHERE contains(lower(name), 'build') OR contains(lower(author_name), 'build')""")
def _(t):
    return G.page_counts(G.matching_skills(effective(t), "Build"), 20)


@query("k2_most_common", "SELECT p_name, count(*) AS rows FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY rows DESC, p_name LIMIT 10")
def _(t):
    return most_common(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), "p_name")


@query("k4_name_page", STORE + "SELECT skill_id, name FROM eff ORDER BY lower(name), skill_id LIMIT 25 OFFSET 75")
def _(t):
    return G.dashboard_page(effective(t), None, "name", False, 4, 25).select("skill_id", "name")


@query("p4_by_category", "SELECT doc_id AS id, lang AS category, source FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 50")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "source")
    return G.by_category(d, "de", 50)


@query("p5_narrow_list", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    return t.documents.drop("text")


@query("p5_document_by_id", "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id = 17")
def _(t):
    return t.documents.where(F.col("doc_id") == 17)


@query("p6_audit_page", """
SELECT event_id, user_id AS skill_id, event_type, (props->>'$.k')::BIGINT AS details FROM events
WHERE user_id = 7 AND event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
ORDER BY ts DESC, event_id DESC LIMIT 5 OFFSET 5""")
def _(t):
    log = t.events.select("event_id", F.col("user_id").alias("skill_id"), "event_type", "ts", F.col("props").alias("details_json"))
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-25"))
    return G.audit_query(log, 7, "click", start, end, 2, 5).select("event_id", "skill_id", "event_type", "details")


@query("p9_review_queue", STORE + """
SELECT skill_id, risk_level, CASE WHEN risk_level IN ('safe','low') THEN 'quick' WHEN risk_level IN ('medium','high','critical') THEN 'careful' ELSE 'other' END AS bucket
FROM eff WHERE status = 'pending' ORDER BY updated_at DESC, skill_id LIMIT 100""")
def _(t):
    return G.review_queue(effective(t), 100).select("skill_id", "risk_level", "bucket")


@query("p10_rescan_candidates", STORE + "SELECT skill_id, risk_level FROM eff WHERE risk_level IN ('high','critical','blocked')")
def _(t):
    return G.rescan_candidates(effective(t)).select("skill_id", "risk_level")


@query("p10_scan_and_test_candidates", STORE + """
SELECT skill_id, 'scan' AS action FROM eff WHERE status = 'pending' UNION ALL SELECT skill_id, 'test' FROM eff WHERE equivalence_score IS NULL""")
def _(t):
    e = effective(t)
    return (G.scan_candidates(e).select("skill_id", F.lit("scan").alias("action"))
            .unionByName(G.untested(e).select("skill_id", F.lit("test").alias("action"))))


INVENTORY_SQL = """
inv AS (SELECT 'src/' || o_orderkey AS path FROM orders WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT 'skills/' || c_name FROM customer WHERE c_nationkey % 3 <> 0
  UNION ALL SELECT 'installed/' || c_name FROM customer WHERE c_acctbal > 0)
"""


def inventory(t: Tables) -> DataFrame:
    c = t.customer
    return (
        t.orders.where(F.col("o_orderkey") % 4 != 0).select(F.concat(F.lit("src/"), F.col("o_orderkey").cast("string")).alias("path"))
        .unionByName(c.where(F.col("c_nationkey") % 3 != 0).select(F.concat(F.lit("skills/"), F.col("c_name")).alias("path")))
        .unionByName(c.where(F.col("c_acctbal") > 0).select(F.concat(F.lit("installed/"), F.col("c_name")).alias("path")))
    )


@query("p11_action_readiness", STORE + "," + INVENTORY_SQL + """
, j AS (SELECT skill_id, source_path, installed_path, source_path IN (FROM inv) IS TRUE AS a, installed_path IN (FROM inv) IS TRUE AS b FROM eff)
SELECT skill_id, a AS can_scan, a AND b AS can_test, concat_ws('; ',
  CASE WHEN NOT a THEN coalesce('source_path does not exist: ' || source_path, 'source_path is not set') END,
  CASE WHEN NOT b THEN coalesce('installed_path does not exist: ' || installed_path, 'installed_path is not set') END) AS reasons FROM j""")
def _(t):
    return G.action_readiness(effective(t), inventory(t))


@query("p12_sync_plan", """
SELECT c_name AS name, CASE WHEN reason IS NULL THEN 'install' ELSE 'skip' END AS action, reason FROM (
  SELECT c_name, CASE WHEN c_acctbal < 0 THEN 'Invalid skill structure' WHEN NOT contains(c_name, '7') THEN 'Name doesn''t match pattern ''7'''
    WHEN c_nationkey % 2 = 0 THEN 'Already installed' END AS reason FROM customer)""")
def _(t):
    c = t.customer
    available = c.select(F.col("c_name").alias("name"), (F.col("c_acctbal") >= 0).alias("valid"))
    return G.sync_plan(available, c.where(F.col("c_nationkey") % 2 == 0).select(F.col("c_name").alias("name")), "7")


@query("p13_normalised_findings", "WITH " + SCANS + """
SELECT scan_id, position, rule_id, coalesce(rule_name, 'Unknown Rule') AS rule_name, coalesce(adjusted, severity) AS severity,
  line_number, file_path, changed AS severity_changed, changed AS in_code_block FROM found""")
def _(t):
    return G.normalised_findings(scans(t))


@query("t47_parsed_findings", "WITH " + SCANS + """
SELECT s.scan_id, count(f.scan_id) AS findings FROM scans s LEFT JOIN found f USING (scan_id) GROUP BY s.scan_id""")
def _(t):
    return scans(t).select("scan_id", F.size(G.parsed_findings(F.col("findings_json"))).cast("long").alias("findings"))


@query("j1_current_revision_left", STORE + "SELECT skill_id, current_revision_id, revision_number FROM eff")
def _(t):
    return G.current_revision(skills(t), revisions(t)).select(
        "skill_id", "current_revision_id", F.col("rev_revision_number").alias("revision_number"))


@query("j2_current_revision_inner", STORE + """
SELECT sk.skill_id, r.revision_id, r.status FROM sk JOIN rev r ON r.revision_id = sk.current_revision_id""")
def _(t):
    return G.current_revision(skills(t), revisions(t), "inner").select(
        "skill_id", F.col("rev_revision_id").alias("revision_id"), F.col("rev_status").alias("status"))


@query("j3_runtime_approvals", STORE + """
, good AS (SELECT canonical_skill_id, r.artifact_digest, min(r.revision_id) AS revision_id FROM sk
  JOIN rev r ON r.revision_id = sk.current_revision_id AND r.skill_id = sk.skill_id AND r.is_current AND r.status = 'approved'
  WHERE canonical_skill_id IS NOT NULL AND r.artifact_digest IS NOT NULL GROUP BY ALL),
req AS (SELECT o_orderkey AS request_id, 'c' || (o_custkey % 1400) AS canonical_skill_id, sha256(o_orderkey::VARCHAR) AS artifact_digest FROM orders)
SELECT request_id, canonical_skill_id, revision_id, revision_id IS NOT NULL AS approved FROM req LEFT JOIN good USING (canonical_skill_id, artifact_digest)""")
def _(t):
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 1400).cast("string")).alias("canonical_skill_id"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("artifact_digest"),
    )
    return G.runtime_approvals(requests, skills(t), revisions(t)).select("request_id", "canonical_skill_id", "revision_id", "approved")


@query("w6_append_revisions", STORE + """
, added AS (SELECT 'n' || o_orderkey AS revision_id, 's' || o_custkey AS skill_id, o_orderdate AS seen_at,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'n' || o_orderkey) AS step FROM orders WHERE o_orderpriority = '1-URGENT'),
m AS (SELECT skill_id, revision_id, revision_number, status, artifact_digest, approved_by FROM rev
  UNION ALL SELECT a.skill_id, a.revision_id, a.step + (SELECT max(revision_number) FROM rev r WHERE r.skill_id = a.skill_id), 'pending', NULL, NULL FROM added a)
SELECT *, revision_number = max(revision_number) OVER (PARTITION BY skill_id) AS is_current FROM m""")
def _(t):
    cols = ["skill_id", "revision_id", "revision_number", "status", "artifact_digest", "approved_by", "is_current"]
    incoming = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("skill_id"),
        F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("revision_id"), F.col("o_orderdate").alias("seen_at"),
    )
    return G.append_revisions(revisions(t).select(*cols), incoming, F.date_trunc("day", "seen_at")).select(*cols)


@query("w7_revision_lineage", "WITH " + REV + """
SELECT skill_id, revision_id, revision_number, row_number() OVER (PARTITION BY skill_id ORDER BY revision_number DESC)::BIGINT AS position FROM rev""")
def _(t):
    return G.lineage(revisions(t), day("updated_at", "order_key")).select("skill_id", "revision_id", "revision_number", "position")


@query("w5_latest_scans", "WITH " + SCANS + """
SELECT skill_id, scan_id, risk_level, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY scanned_at DESC, scan_id DESC)::BIGINT AS rank FROM scans) WHERE rank <= 3""")
def _(t):
    return G.latest_per_skill(scans(t), "scanned_at", "scan_id", 3).select("skill_id", "scan_id", "risk_level", "rank")


@query("k5_recent_scans", "WITH " + SCANS + """
SELECT skill_id, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY scanned_at DESC, scan_id DESC) rn FROM scans)
WHERE rn <= 5 ORDER BY scanned_at DESC, scan_id DESC LIMIT 100""")
def _(t):
    return G.recent_scans(scans(t), 5, 100).select("skill_id", "scan_id")


@query("w16_rescan_deltas", "WITH " + SCANS + """
SELECT * FROM (SELECT skill_id, scan_id, risk_level, risk_score, lag(risk_level) OVER w AS prev_risk_level, lag(risk_score) OVER w AS prev_risk_score
  FROM scans WINDOW w AS (PARTITION BY skill_id ORDER BY scanned_at, scan_id)) WHERE prev_risk_score IS NOT NULL""")
def _(t):
    s = scans(t).select("skill_id", "scan_id", "scanned_at", "risk_level", "risk_score")
    return G.rescan_deltas(s, day("scanned_at", "scan_id")).drop("scanned_at")


@query("a26_rescan_improvement", "WITH " + SCANS + """
, p AS (SELECT *, row_number() OVER w rn, lead(risk_score) OVER w AS old_score, lead(risk_level) OVER w AS old_level
  FROM scans WINDOW w AS (PARTITION BY skill_id ORDER BY scanned_at DESC, scan_id DESC))
SELECT count(*) AS rescanned, count_if(old_score > risk_score)::BIGINT AS risk_reduced,
  coalesce(sum(CASE WHEN old_score > risk_score THEN old_score - risk_score END), 0)::BIGINT AS total_score_reduction,
  count_if(old_level <> risk_level)::BIGINT AS level_changes FROM p WHERE rn = 1 AND old_score IS NOT NULL""")
def _(t):
    return G.rescan_improvement(scans(t))


@query("a27_scan_distribution", "WITH " + SCANS + """
SELECT risk_level, count(*) AS scans, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM scans WHERE succeeded GROUP BY risk_level""")
def _(t):
    return G.scan_distribution(scans(t))


@query("a1_corpus_statistics", """
SELECT coalesce(lang, '<all>') AS category, count(*) AS documents, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (lang)""")
def _(t):
    return G.corpus_statistics(t.documents.select(F.col("lang").alias("category"), "n_chars"), ["n_chars"])


@query("a2_governance_statistics", STORE + """
SELECT 'by_status' AS metric, status AS key, count(*) AS value FROM eff WHERE status IS NOT NULL GROUP BY status
UNION ALL SELECT 'by_risk', risk_level, count(*) FROM eff WHERE risk_level IS NOT NULL GROUP BY risk_level
UNION ALL SELECT 'total', 'skills', count(*) FROM eff UNION ALL SELECT 'total', 'scans', count(*) FROM orders
UNION ALL SELECT 'total', 'tests', count(*) FROM labels UNION ALL SELECT 'total', 'audit_events', count(*) FROM events""")
def _(t):
    return G.governance_statistics(effective(t), {"scans": scans(t), "tests": t.labels, "audit_events": t.events})


@query("a3_overview", STORE + """
SELECT count(*) AS total_skills, count_if(status = 'pending')::BIGINT AS pending_count, count_if(status = 'approved')::BIGINT AS approved_count,
  count_if(status = 'rejected')::BIGINT AS rejected_count, count_if(status = 'blocked')::BIGINT AS blocked_count,
  count_if(risk_level IN ('high','critical'))::BIGINT AS high_risk_count, round(coalesce(avg(equivalence_score), 0), 2) AS avg_fidelity_score FROM eff""")
def _(t):
    return G.overview(effective(t))


@query("a4_distributions", STORE + """
SELECT 'risk' AS kind, level, (SELECT count(*) FROM eff WHERE risk_level = level) AS rows FROM (SELECT unnest(['safe','low','medium','high','critical','blocked']) AS level)
UNION ALL SELECT 'status', level, (SELECT count(*) FROM eff WHERE status = level) FROM (SELECT unnest(['pending','approved','rejected','blocked']) AS level)""")
def _(t):
    e = effective(t)
    risk = G.distribution(e, "risk_level", V.RISK_LEVELS).withColumn("kind", F.lit("risk"))
    return risk.unionByName(G.distribution(e, "status", V.STATUSES).withColumn("kind", F.lit("status")))


@query("a5_findings_by_rule", "WITH " + SCANS + """
SELECT rule_id, arg_min(coalesce(rule_name, rule_id), (scanned_at, scan_id, position)) AS rule_name,
  arg_min(severity, (scanned_at, scan_id, position)) AS severity, count(*) AS findings FROM found GROUP BY rule_id""")
def _(t):
    return G.findings_by_rule(scans(t))


@query("a18_job_summary", "WITH " + ITEMS + f"""
SELECT job_id, count(*) AS total, {", ".join(f"count_if(status = '{s}')::BIGINT AS {s}" for s in V.ITEM_STATUSES)},
  count(DISTINCT claimed_by) AS active_workers, strftime(max(lease_expires_at) FILTER (status = 'running'), {TS}) AS active_lease_expires_at,
  strftime(max(started_at), {TS}) AS last_item_started_at, strftime(max(completed_at), {TS}) AS last_item_completed_at
FROM items GROUP BY job_id""")
def _(t):
    times = ["active_lease_expires_at", "last_item_started_at", "last_item_completed_at"]
    out = G.job_summary(job_items(t)).drop("first_error")
    return out.withColumns({c: F.date_format(c, SECONDS) for c in times})


@query("a19_job_final_state", "WITH " + ITEMS + """
, s AS (SELECT job_id, count_if(status IN ('queued','running','retrying')) AS open, count_if(status = 'failed') AS failed,
  count_if(status = 'succeeded') AS succeeded, arg_min(error_code, (created_at, item_id)) FILTER (status = 'failed') AS first_error FROM items GROUP BY job_id),
j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 10 = 0 THEN 'cancelled' ELSE 'running' END AS job_status FROM orders)
SELECT job_id, CASE WHEN open > 0 THEN job_status WHEN job_status = 'cancelled' THEN 'cancelled' WHEN coalesce(failed, 0) = 0 THEN 'completed'
  WHEN succeeded = 0 THEN 'failed' ELSE 'completed_with_failures' END AS final_status,
  CASE WHEN open > 0 THEN NULL WHEN job_status = 'cancelled' THEN 'JOB_CANCELLED' WHEN failed > 0 THEN first_error END AS error_code
FROM j LEFT JOIN s USING (job_id)""")
def _(t):
    jobs = t.orders.select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 10 == 0, "cancelled").otherwise("running").alias("job_status"),
        F.lit(None).cast("string").alias("job_error"),
    )
    return G.job_final_state(jobs, job_items(t))


@query("t42_item_advice", "WITH " + ITEMS + """
SELECT job_id, item_id, lease_expires_at IS NULL OR lease_expires_at <= TIMESTAMP '1998-01-01' AS lease_expired,
  coalesce(error_code, '') IN ('TIMEOUT') AS retriable,
  CASE WHEN status IN ('queued','retrying') THEN 'wait_for_worker' WHEN status = 'running' THEN 'monitor_lease_or_cancel'
    WHEN status = 'succeeded' THEN 'no_action' WHEN status = 'cancelled' THEN 'review_cancel_trace' WHEN status = 'skipped' THEN 'review_skip_reason'
    WHEN error_code = 'PATH_NOT_FOUND' THEN 'fix_source_path' WHEN error_code = 'INSTALLED_PATH_MISSING' THEN 'fix_installed_path'
    WHEN error_code = 'TIMEOUT' THEN 'retry_item' ELSE 'inspect_error' END AS next_step FROM items""")
def _(t):
    return job_items(t).select(
        "job_id", "item_id", G.lease_expired(F.lit("1998-01-01").cast("timestamp_ntz")).alias("lease_expired"),
        G.retriable().alias("retriable"), G.next_step().alias("next_step"),
    )


@query("k3_risk_report", STORE + """
SELECT risk_level, count(*) AS skills, round(avg(risk_score), 4) AS avg_score,
  CASE risk_level WHEN 'blocked' THEN 1 WHEN 'critical' THEN 2 WHEN 'high' THEN 3 WHEN 'medium' THEN 4 WHEN 'low' THEN 5 WHEN 'safe' THEN 6 ELSE 7 END::BIGINT AS place
FROM eff GROUP BY risk_level""")
def _(t):
    return G.risk_report(effective(t))


@query("t34_source_checksum", """
SELECT o_orderkey, sha256('{"converted_at": "", "fetched_at": "' || strftime(o_orderdate, '%Y-%m-%d') || '", "source_commit": "' || o_orderstatus ||
  '", "source_path": "' || CASE WHEN o_orderkey % 5 <> 0 THEN 'src/' || o_orderkey ELSE '' END || '", "source_type": "' || o_orderpriority ||
  '", "source_url": "say \\\\"' || o_custkey || '\\\\"", "version": "1.0"}') AS checksum FROM orders""".replace("\\\\", "\\"))
def _(t):
    payload = t.orders.select(
        "o_orderkey", F.lit(None).cast("string").alias("converted_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fetched_at"),
        F.col("o_orderstatus").alias("source_commit"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"))).alias("source_path"),
        F.col("o_orderpriority").alias("source_type"),
        F.concat(F.lit('say "'), F.col("o_custkey").cast("string"), F.lit('"')).alias("source_url"), F.lit("1.0").alias("version"),
    )
    return payload.select("o_orderkey", G.source_checksum().alias("checksum"))


@query("q5_duplicate_canonical_ids", STORE + """
SELECT canonical_skill_id, count(*) AS skills FROM sk WHERE canonical_skill_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return G.duplicate_canonical_ids(skills(t))


@query("q6_approval_violations", STORE + """
, j AS (SELECT r.revision_id, r.artifact_digest, sk.* EXCLUDE (skill_id) FROM rev r JOIN sk USING (skill_id) WHERE r.status = 'approved')
SELECT revision_id, 'skill_blocked' AS violation FROM j WHERE status = 'blocked'
UNION ALL SELECT revision_id, 'not_current_revision' FROM j WHERE revision_id IS DISTINCT FROM current_revision_id
UNION ALL SELECT revision_id, 'no_canonical_id' FROM j WHERE canonical_skill_id IS NULL
UNION ALL SELECT revision_id, 'no_artifact_digest' FROM j WHERE artifact_digest IS NULL""")
def _(t):
    return G.approval_violations(skills(t), revisions(t))


@query("j15_backfill", """
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'own' END, r_name, '') AS org,
  coalesce(CASE WHEN c_nationkey % 4 = 0 THEN 'https://example.org/' || n_name END, 'https://example.org/default/' || c_custkey) AS url
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    c = t.customer.select(
        "c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "own").otherwise("").alias("org"), F.lit(None).cast("string").alias("url"))
    n, r = t.nation, t.region
    orgs = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("key"), F.col("r_name").alias("value"))
    urls = n.where(F.col("n_nationkey") % 4 == 0).select(
        F.col("n_nationkey").alias("key"), F.concat(F.lit("https://example.org/"), F.col("n_name")).alias("value"))
    default = F.concat(F.lit("https://example.org/default/"), F.col("c_custkey").cast("string"))
    filled = G.backfill(c, orgs, "c_nationkey", "org")
    return G.backfill(filled, urls, "c_nationkey", "url", default).select("c_custkey", "org", "url")


@query("j16_provenance_backfill", """
SELECT c.c_custkey AS skill_id, CASE WHEN c_nationkey % 4 = 0 THEN 'missing_original' WHEN c_nationkey % 3 = 0 THEN 'updated_without_conversion' ELSE 'updated' END AS result,
  CASE WHEN c_nationkey % 4 <> 0 THEN coalesce(n, 0) + 1 END AS revision_number
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def _(t):
    c = t.customer
    sk = c.select(F.col("c_custkey").alias("skill_id"), F.col("c_name").alias("name"))
    originals = c.where(F.col("c_nationkey") % 4 != 0).select(F.col("c_name").alias("name"), F.concat(F.lit("in/"), F.col("c_name")).alias("path"))
    converted = c.where(F.col("c_nationkey") % 3 != 0).select(F.col("c_name").alias("name"), F.concat(F.lit("out/"), F.col("c_name")).alias("path"))
    counts = t.orders.groupBy(F.col("o_custkey").alias("skill_id")).agg(F.count(F.lit(1)).alias("revision_number"))
    matches = G.provenance_matches(sk, originals, converted)
    added = G.provenance_revisions(matches, counts).select("skill_id", "revision_number")
    return matches.select("skill_id", "result").join(added, "skill_id", "left")


@query("t38_https_urls", """
SELECT page_id, regexp_replace(regexp_replace(trim(raw), '^git@([^:]*):(.*)$', 'https://\\1/\\2'), '\\.git$', '') AS url
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?://([^/]*)/(.*)$', 'git@\\1:\\2.git')
  WHEN 1 THEN ' ' || url || '.git ' ELSE url END AS raw FROM pages)""")
def _(t):
    kind = F.col("page_id") % 3
    raw = (
        F.when(kind == 0, F.regexp_replace("url", "^https?://([^/]*)/(.*)$", "git@$1:$2.git"))
        .when(kind == 1, F.concat(F.lit(" "), F.col("url"), F.lit(".git "))).otherwise(F.col("url"))
    )
    return t.pages.select("page_id", G.https_url(raw).alias("url"))

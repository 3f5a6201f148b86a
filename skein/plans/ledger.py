"""Ledger queries over the ``events`` table.

A run is a user's day. Event type, key, action and payload derive from
``event_type`` and ``props.k``, so every row of the table is a ledger event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import ledger_values as V
from skein.operators import ledger as L
from skein.plans.registry import Tables, query

KINDS = {
    "signup": ["run_created"],
    "view": ["action_started", "action_succeeded", "run_resume_started", "action_outcome_unknown",
             "preflight_passed", "action_failed"],
    "click": ["approval_required", "approval_granted", "policy_denied", "approval_rejected"],
    "purchase": ["run_succeeded", "compensation_succeeded", "compensation_queued"],
    "error": ["run_failed", "reconciliation_required", "run_suspended", "run_cancelled",
              "run_recovery_failed", "run_compensated", "manual_recovery_confirmed"],
}
STRATEGIES = ["auto_rollback", "manual_approval", "human_intervention", "none"]
NOW = "2024-01-20 00:00:00"
TTL = 900


def events(t: Tables) -> DataFrame:
    """Ledger rows without the sequence."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F
    for source, targets in KINDS.items():
        names = F.array(*[F.lit(x) for x in targets])
        kind = kind.when(F.col("event_type") == source, F.element_at(names, F.col("k") % len(targets) + 1))
    strategies = F.array(*[F.lit(x) for x in STRATEGIES])
    base = t.events.withColumn("k", k)
    return base.select(
        "event_id",
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.when(F.col("k") == 99, "3.0.0").otherwise(V.EVENT_SCHEMA_VERSION).alias("schema_version"),
        kind.alias("event_type"),
        F.col("ts").alias("occurred_at"),
        F.concat(F.lit("skill_"), (F.col("user_id") % 5).cast("string")).alias("skill_name"),
        F.concat(F.lit("1."), (F.col("user_id") % 3).cast("string")).alias("skill_version"),
        F.format_string("a_%03d", F.col("k") % 20).alias("action_id"),
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("idempotency_key"),
        F.when(F.col("k") % 3 != 0, "failure text").alias("reason"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("E_"), (F.col("k") % 7).cast("string")))
        .otherwise(F.concat(F.lit("e"), (F.col("k") % 7).cast("string"))).alias("reason_code"),
        F.element_at(strategies, F.col("k") % 4 + 1).alias("strategy"),
        F.concat(F.lit("k"), (F.col("k") + 1).cast("string")).alias("compensation_key"),
        F.concat(F.lit("policy-"), (F.col("k") % 10).cast("string")).alias("governance_ref"),
        "k",
        "value",
        "user_id",
    )


def ledger(t: Tables) -> DataFrame:
    return L.with_sequence(events(t))


def runs(t: Tables) -> DataFrame:
    """Runs as recorded by the last event, mapped or not."""
    order = F.struct("occurred_at", "event_id")
    last = F.coalesce(L.lookup(V.STATUS_BY_EVENT, F.max_by("event_type", order)), F.lit("running"))
    return events(t).groupBy("run_id").agg(
        F.min("skill_name").alias("skill_name"),
        F.min("skill_version").alias("skill_version"),
        last.alias("status"),
        F.min("occurred_at").alias("created_at"),
        F.max("occurred_at").alias("updated_at"),
    )


def hitl_items(t: Tables) -> DataFrame:
    e = events(t).where(F.col("event_type").isin("approval_required", "run_suspended"))
    statuses = F.array(*[F.lit(x) for x in ["pending", "approved", "rejected", "confirmed", "pending", "lost"]])
    return e.select(
        F.col("event_id").alias("item_id"),
        "run_id",
        "action_id",
        F.when(F.col("event_type") == "run_suspended", "manual_recovery")
        .when(F.col("k") % 11 == 0, "other").otherwise("action_approval").alias("kind"),
        F.element_at(statuses, (F.floor("value") % 6).cast("int") + 1).alias("status"),
        F.when(F.col("k") % 5 == 0, F.sha2(F.col("action_id"), 256)).otherwise(F.sha2(F.col("run_id"), 256)).alias("basis_digest"),
        F.when(F.col("k") % 10 != 0, L.expires_at(F.col("occurred_at"), TTL * 96 * 7)).alias("expires_at"),
        F.col("occurred_at").alias("created_at"),
    )


def decisions(t: Tables) -> DataFrame:
    """Each decision event decides the first item of its run."""
    first = hitl_items(t).groupBy("run_id").agg(F.min_by("item_id", F.struct("created_at", "item_id")).alias("item_id"))
    verdicts = {"approval_granted": "approve", "approval_rejected": "reject", "manual_recovery_confirmed": "confirm_recovered"}
    e = events(t).where(F.col("event_type").isin(*verdicts))
    return e.select(
        F.col("event_id").alias("decision_id"), "run_id",
        L.lookup(verdicts, F.col("event_type")).alias("decision"), F.col("occurred_at").alias("decided_at"),
    ).join(first, "run_id").drop("run_id")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_KIND_SQL = " ".join(f"WHEN '{s}' THEN {_list(x)}[k % {len(x)} + 1]" for s, x in KINDS.items())
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.STATUS_BY_EVENT.items()) + " END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


LEDGER_SQL = f"""
WITH raw AS (SELECT *, (props->>'$.k')::INT AS k FROM events),
led AS (
  SELECT event_id, user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS run_id,
    CASE WHEN k = 99 THEN '3.0.0' ELSE '4.0.0' END AS schema_version,
    CASE event_type {_KIND_SQL} END AS event_type, ts AS occurred_at,
    'skill_' || (user_id % 5) AS skill_name, '1.' || (user_id % 3) AS skill_version,
    'a_' || lpad((k % 20)::VARCHAR, 3, '0') AS action_id, 'k' || k AS idempotency_key,
    CASE WHEN k % 3 <> 0 THEN 'failure text' END AS reason,
    CASE WHEN k % 2 = 0 THEN 'E_' || (k % 7) ELSE 'e' || (k % 7) END AS reason_code,
    {_list(STRATEGIES)}[k % 4 + 1] AS strategy, 'k' || (k + 1) AS compensation_key,
    'policy-' || (k % 10) AS governance_ref, k, value, user_id
  FROM raw),
e AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY occurred_at, event_id)::BIGINT AS sequence,
    {_STATUS_SQL} AS status FROM led),
runs AS (
  SELECT run_id, min(skill_name) skill_name, min(skill_version) skill_version,
    coalesce(arg_max(CASE WHEN status IS NULL THEN 'running' ELSE status END, sequence), 'running') AS status,
    min(occurred_at) created_at, max(occurred_at) updated_at
  FROM e GROUP BY run_id),
items AS (
  SELECT event_id AS item_id, run_id, action_id,
    CASE WHEN event_type = 'run_suspended' THEN 'manual_recovery' WHEN k % 11 = 0 THEN 'other' ELSE 'action_approval' END AS kind,
    ['pending', 'approved', 'rejected', 'confirmed', 'pending', 'lost'][(floor(value)::BIGINT % 6) + 1] AS status,
    CASE WHEN k % 5 = 0 THEN sha256(action_id) ELSE sha256(run_id) END AS basis_digest,
    CASE WHEN k % 10 <> 0 THEN occurred_at + INTERVAL '{TTL * 96 * 7} seconds' END AS expires_at,
    occurred_at AS created_at
  FROM e WHERE event_type IN ('approval_required', 'run_suspended')),
decisions AS (
  SELECT event_id AS decision_id, f.item_id,
    CASE event_type WHEN 'approval_granted' THEN 'approve' WHEN 'approval_rejected' THEN 'reject' ELSE 'confirm_recovered' END AS decision,
    occurred_at AS decided_at
  FROM e JOIN (SELECT run_id, arg_min(item_id, (created_at, item_id)) AS item_id FROM items GROUP BY run_id) f USING (run_id)
  WHERE event_type IN ('approval_granted', 'approval_rejected', 'manual_recovery_confirmed'))
"""


@query("w1_event_sequence", LEDGER_SQL + "SELECT run_id, event_id, sequence FROM e")
def _(t):
    return ledger(t).select("run_id", "event_id", "sequence")


@query("s6_ledger_scan_by_skill", LEDGER_SQL + """
SELECT run_id, event_id, sequence, event_type FROM e WHERE skill_name = 'skill_3' AND skill_version = '1.1'""")
def _(t):
    return L.scan_by_skill(ledger(t), "skill_3", "1.1").select("run_id", "event_id", "sequence", "event_type")


_TWICE = " OR ".join(f"count_if(event_type = '{x}') > 1" for x in V.UNIQUE_TERMINAL_EVENTS)


@query("w2_stream_violations", LEDGER_SQL + f"""
, f AS (
  SELECT e.run_id, min(sequence) <> 1 OR max(sequence) <> count(*) OR count(DISTINCT sequence) <> count(*) AS gaps,
    arg_min(event_type, sequence) <> 'run_created' AS start, {_TWICE} AS twice,
    count_if(e.skill_name <> runs.skill_name OR e.skill_version <> runs.skill_version) > 0 AS other,
    count_if(schema_version <> '4.0.0') > 0 AS odd,
    arg_max(e.status, sequence) FILTER (e.status IS NOT NULL) IS DISTINCT FROM any_value(runs.status) AS drift
  FROM runs JOIN e USING (run_id) GROUP BY e.run_id)
SELECT run_id, 'sequence_not_contiguous' AS violation FROM f WHERE gaps
UNION ALL SELECT run_id, 'must_begin_with_run_created' FROM f WHERE start
UNION ALL SELECT run_id, 'duplicate_terminal' FROM f WHERE twice
UNION ALL SELECT run_id, 'skill_identity_mismatch' FROM f WHERE other
UNION ALL SELECT run_id, 'unsupported_schema_version' FROM f WHERE odd
UNION ALL SELECT run_id, 'status_projection_mismatch' FROM f WHERE drift""")
def _(t):
    return L.stream_violations(ledger(t), runs(t))


@query("w3_illegal_events", LEDGER_SQL + f"""
, x AS (
  SELECT *, max(event_type IN {_in(V.FINAL_EVENTS)}) OVER w AS after_final,
    max(event_type IN {_in(V.OUTCOME_EVENTS)}) OVER w AS after_outcome
  FROM e WINDOW w AS (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run_id, event_id, sequence, event_type,
  CASE WHEN after_final THEN 'after_final_terminal' ELSE 'invalid_after_outcome' END AS violation
FROM x WHERE after_final OR (after_outcome AND event_type NOT IN {_in(V.ALLOWED_AFTER_OUTCOME)})""")
def _(t):
    return L.illegal_events(ledger(t))


@query("w4_projected_status", LEDGER_SQL + """
SELECT run_id, arg_max(status, sequence) AS status FROM e WHERE status IS NOT NULL GROUP BY run_id""")
def _(t):
    return L.projected_status(ledger(t))


@query("w8_claim_results", LEDGER_SQL + """
, c AS (SELECT *, first_value(event_id) OVER w AS first_id, first_value(run_id || '/' || action_id) OVER w AS owner
  FROM e WINDOW w AS (PARTITION BY idempotency_key ORDER BY occurred_at, event_id))
SELECT event_id AS claim_id, run_id, idempotency_key,
  CASE WHEN event_id = first_id THEN 'created' WHEN run_id || '/' || action_id = owner THEN 'owned' ELSE 'conflict' END AS result
FROM c""")
def _(t):
    claims = events(t).select(
        F.col("event_id").alias("claim_id"), "run_id", "action_id", F.lit("primary").alias("purpose"),
        "idempotency_key", F.col("occurred_at").alias("claimed_at"),
    )
    return L.claim_results(claims).select("claim_id", "run_id", "idempotency_key", "result")


@query("w13_unfinished_resume", LEDGER_SQL + f"""
SELECT run_id, max(sequence) FILTER (event_type = 'run_resume_started') AS resume_sequence FROM e GROUP BY run_id
HAVING resume_sequence > coalesce(max(sequence) FILTER (event_type IN {_in(V.RESUME_CLOSURE_EVENTS)}), 0)""")
def _(t):
    return L.unfinished_resumes(ledger(t))


@query("w14_ambiguous_actions", LEDGER_SQL + f"""
SELECT event_id, run_id, action_id, idempotency_key, sequence FROM e s WHERE event_type = 'action_started'
AND NOT EXISTS (SELECT 1 FROM e x WHERE x.run_id = s.run_id AND x.action_id = s.action_id
  AND x.idempotency_key = s.idempotency_key AND x.event_type IN {_in(V.ACTION_END_EVENTS)})""")
def _(t):
    return L.ambiguous_actions(ledger(t))


@query("w15_recovery_candidates", LEDGER_SQL + """
SELECT run_id, event_id, action_id, sequence, strategy,
  row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC)::BIGINT AS undo_order
FROM e s WHERE event_type = 'action_succeeded' AND strategy <> 'none'
AND NOT EXISTS (SELECT 1 FROM e x WHERE x.run_id = s.run_id AND x.event_type = 'manual_recovery_confirmed' AND x.action_id = s.action_id)
AND NOT (strategy = 'auto_rollback' AND EXISTS (SELECT 1 FROM e x WHERE x.run_id = s.run_id
  AND x.event_type = 'compensation_succeeded' AND x.idempotency_key = s.compensation_key))""")
def _(t):
    return L.recovery_candidates(ledger(t))


_OUTCOME_SQL = LEDGER_SQL + """
, o AS (
  SELECT run_id, skill_name, skill_version, list_distinct(list(event_type)) AS ts FROM e GROUP BY ALL),
outcomes AS (
  SELECT run_id, skill_name, skill_version,
    CASE WHEN 'run_compensated' IN ts THEN 'compensated' WHEN 'run_recovery_failed' IN ts THEN 'recovery_failed'
      WHEN 'reconciliation_required' IN ts THEN 'reconciliation_required' WHEN 'run_suspended' IN ts THEN 'hitl_required'
      WHEN 'run_cancelled' IN ts THEN 'cancelled'
      WHEN 'compensation_queued' IN ts AND 'run_succeeded' NOT IN ts THEN 'recovery_pending'
      WHEN 'run_succeeded' IN ts THEN 'succeeded' WHEN 'run_failed' IN ts THEN 'failed'
      WHEN 'policy_denied' IN ts THEN 'denied'
      WHEN 'approval_required' IN ts AND 'approval_granted' NOT IN ts THEN 'awaiting_approval' END AS outcome
  FROM o)
"""


@query("a20_run_outcomes", _OUTCOME_SQL + """
SELECT skill_name, skill_version, outcome, count(*) AS runs FROM outcomes WHERE outcome IS NOT NULL GROUP BY ALL""")
def _(t):
    return L.outcome_counts(events(t))


_PATTERN_SQL = f"""
pats AS (SELECT DISTINCT skill_name, skill_version,
    event_type || CASE WHEN regexp_matches(reason_code, '{V.SAFE_REASON_CODE}') THEN ':' || reason_code ELSE '' END AS pattern
  FROM e WHERE event_type IN {_in(V.FAILURE_EVENTS)} AND reason IS NOT NULL)
"""


@query("a21_evidence_summary", _OUTCOME_SQL + "," + _PATTERN_SQL + f"""
, c AS (SELECT skill_name, skill_version, {", ".join(f"count_if(outcome = '{x}')::BIGINT AS {x}" for x in V.OUTCOMES)}
  FROM outcomes GROUP BY ALL),
t AS (SELECT skill_name, skill_version, count(*) AS source_event_watermark, max(occurred_at) AS g,
  count(DISTINCT action_id) AS element_refs FROM e GROUP BY ALL)
SELECT t.skill_name, t.skill_version, source_event_watermark, strftime(g, '%Y-%m-%d %H:%M:%S') AS generated_at,
  {", ".join(V.OUTCOMES)}, succeeded + failed + compensated + recovery_failed AS sample_size,
  round(succeeded / nullif(sample_size, 0), 6) AS success_rate, round(least(1.0, sample_size / 10.0), 6)::DOUBLE AS confidence,
  element_refs, (SELECT count(*) FROM pats p WHERE p.skill_name = t.skill_name AND p.skill_version = t.skill_version) AS failure_patterns
FROM t JOIN c USING (skill_name, skill_version)""")
def _(t):
    return L.evidence_summary(events(t)).withColumn("generated_at", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss"))


@query("a21_element_refs", LEDGER_SQL + "SELECT DISTINCT skill_name, skill_version, action_id FROM e")
def _(t):
    return L.element_refs(events(t), ["skill_name", "skill_version"])


@query("t40_failure_patterns", LEDGER_SQL + "," + _PATTERN_SQL + "SELECT * FROM pats")
def _(t):
    return L.failure_patterns(events(t), ["skill_name", "skill_version"])


@query("a22_run_evidence", LEDGER_SQL + """
SELECT run_id, count(*) AS event_count, max(sequence) AS watermark, arg_max(event_type, sequence) AS last_event_type,
  strftime(arg_max(occurred_at, sequence), '%Y-%m-%d %H:%M:%S') AS generated_at,
  arg_min(governance_ref, sequence) FILTER (event_type = 'preflight_passed') AS governance_ref
FROM e GROUP BY run_id""")
def _(t):
    return L.run_evidence(ledger(t)).withColumn("generated_at", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss"))


@query("p7_approval_queue", LEDGER_SQL + f"""
, x AS (SELECT item_id, run_id, kind, created_at,
  CASE WHEN status IN ('pending', 'approved') AND (expires_at IS NULL OR expires_at <= TIMESTAMP '{NOW}') THEN 'expired' ELSE status END AS status
  FROM items)
SELECT item_id, run_id, kind, status FROM x WHERE status = 'expired' ORDER BY created_at, item_id LIMIT 100""")
def _(t):
    now = F.lit(NOW).cast("timestamp_ntz")
    return L.approval_queue(hitl_items(t), now, "expired", limit=100).select("item_id", "run_id", "kind", "status")


@query("t41_effective_item_status", LEDGER_SQL + f"""
SELECT item_id, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at,
  CASE WHEN status IN ('pending', 'approved') AND (expires_at IS NULL OR expires_at <= TIMESTAMP '{NOW}') THEN 'expired' ELSE status END AS status
FROM items""")
def _(t):
    return hitl_items(t).select(
        "item_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"),
        L.effective_status(F.lit(NOW).cast("timestamp_ntz")).alias("status"),
    )


@query("p8_event_counts", LEDGER_SQL + "SELECT run_id, event_type, count(*) AS events FROM e GROUP BY ALL")
def _(t):
    return L.event_counts(events(t))


@query("p8_runs_with_event", LEDGER_SQL + """
SELECT run_id, status FROM runs WHERE run_id IN (SELECT run_id FROM e WHERE event_type = 'run_failed' AND idempotency_key = 'k7')""")
def _(t):
    return L.runs_with_event(runs(t), events(t), "run_failed", "k7").select("run_id", "status")


@query("w18_pending_once", LEDGER_SQL + """
, x AS (SELECT *, row_number() OVER (PARTITION BY run_id, action_id, kind, status ORDER BY created_at, item_id) rn FROM items)
SELECT item_id, run_id, action_id, kind, status FROM x WHERE status <> 'pending' OR rn = 1""")
def _(t):
    return L.pending_once(hitl_items(t)).select("item_id", "run_id", "action_id", "kind", "status")


@query("j19_decision_violations", LEDGER_SQL + """
, b AS (SELECT run_id, sha256(run_id) AS execution_digest FROM runs WHERE skill_version <> '1.0'),
j AS (
  SELECT d.decision_id, d.item_id, kind, decision, runs.status AS run_status, execution_digest, basis_digest
  FROM decisions d LEFT JOIN items USING (item_id) LEFT JOIN runs ON runs.run_id = items.run_id LEFT JOIN b ON b.run_id = items.run_id)
SELECT decision_id, item_id, 'decision_not_allowed' AS violation FROM j
  WHERE NOT ((kind = 'action_approval' AND decision IN ('approve', 'reject')) OR (kind = 'manual_recovery' AND decision IN ('confirm_recovered', 'reject')))
UNION ALL SELECT decision_id, item_id, 'run_not_awaiting' FROM j
  WHERE run_status IS DISTINCT FROM CASE WHEN kind = 'action_approval' THEN 'awaiting_approval' ELSE 'hitl_required' END
UNION ALL SELECT decision_id, item_id, 'basis_mismatch' FROM j WHERE execution_digest IS NULL OR execution_digest <> basis_digest""")
def _(t):
    r = runs(t)
    bases = r.where(F.col("skill_version") != "1.0").select("run_id", F.sha2("run_id", 256).alias("execution_digest"))
    return L.decision_violations(decisions(t), hitl_items(t), r, bases)


@query("j20_certified_scope", """
WITH line AS (SELECT l_orderkey, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
allowed AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size >= 2)
SELECT l_orderkey AS request_id, count(*) AS requested, count_if(a.p_brand IS NULL)::BIGINT AS outside,
  count_if(a.p_brand IS NULL) = 0 AS certified
FROM line LEFT JOIN allowed a USING (p_brand, p_type) GROUP BY l_orderkey""")
def _(t):
    part = t.part
    asked = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("request_id"), "p_brand", "p_type"
    )
    return L.certified_requests(asked, part.where(F.col("p_size") >= 2), ["p_brand", "p_type"])


@query("q1_duplicate_positions", LEDGER_SQL + """
SELECT run_id, sequence, events FROM (
  SELECT run_id, (floor(value)::BIGINT) AS sequence, count(*) AS events FROM e GROUP BY ALL) WHERE events > 1""")
def _(t):
    claimed = events(t).withColumn("sequence", F.floor("value"))
    return L.duplicate_positions(claimed)


@query("q2_orphans", LEDGER_SQL + """
, r AS (SELECT DISTINCT run_id FROM e WHERE event_type = 'run_created')
SELECT 'events' AS child, run_id, count(*) AS rows FROM e WHERE run_id NOT IN (FROM r) GROUP BY run_id
UNION ALL SELECT 'hitl_items', run_id, count(*) FROM items WHERE run_id NOT IN (FROM r) GROUP BY run_id""")
def _(t):
    e = events(t)
    created = e.where(F.col("event_type") == "run_created").select("run_id").distinct()
    return L.orphans({"events": e, "hitl_items": hitl_items(t)}, created)


@query("q3_domain_violations", LEDGER_SQL + f"""
SELECT 'kind' AS field, kind AS value, count(*) AS rows FROM items WHERE kind NOT IN {_in(V.HITL_KINDS)} GROUP BY kind
UNION ALL SELECT 'status', status, count(*) FROM items WHERE status NOT IN {_in(V.HITL_STATUSES)} GROUP BY status""")
def _(t):
    return L.domain_violations(hitl_items(t), {"kind": V.HITL_KINDS, "status": V.HITL_STATUSES})


@query("q4_decision_agreement", LEDGER_SQL + """
, d AS (SELECT item_id, count(*) AS n, arg_min(decision, (decided_at, decision_id)) AS decision FROM decisions GROUP BY item_id),
j AS (SELECT items.item_id, n, status, CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'confirmed' END AS agreed
  FROM items JOIN d USING (item_id))
SELECT item_id, 'several_decisions' AS violation FROM j WHERE n > 1
UNION ALL SELECT item_id, 'status_mismatch' FROM j WHERE agreed IS DISTINCT FROM status""")
def _(t):
    return L.decision_agreement(hitl_items(t), decisions(t))


@query("u8_changed_history", """
WITH b AS (SELECT event_id, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-20'),
n AS (SELECT event_id, user_id, event_type, value + CASE WHEN props = '{"k": 13}' THEN 1 ELSE 0 END AS value FROM events)
SELECT * FROM b EXCEPT ALL SELECT * FROM n""")
def _(t):
    e = t.events
    cols = ["event_id", "user_id", "event_type", "value"]
    later = e.withColumn("value", F.col("value") + F.when(F.get_json_object("props", "$.k") == "13", 1).otherwise(0))
    earlier = e.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return L.changed_history(earlier.select(*cols), later.select(*cols))


@query("t43_key_templates", LEDGER_SQL + """
SELECT event_id, props->>'$.k' AS pointer_value, 'lock/' || user_id || ':' || strftime(ts, '%Y-%m-%d') || '/' || k AS lock_key,
  NULL::VARCHAR AS unresolved FROM raw""")
def _(t):
    e = t.events
    run = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    found = L.json_pointer(F.col("props"), "/k")
    tokens = {"run_id": run, "input.k": found}
    return e.select(
        "event_id", found.alias("pointer_value"),
        L.key_from_template("lock/{run_id}/{input.k}", tokens).alias("lock_key"),
        L.key_from_template("{external_resource_id}", tokens).alias("unresolved"),
    )


@query("t44_policy_decisions", """
WITH b AS (
  SELECT l_orderkey * 10 + l_linenumber AS binding_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INT AS q,
    CASE l_returnflag WHEN 'A' THEN 'bounded_write' WHEN 'R' THEN 'destructive_write'
      ELSE CASE WHEN l_linenumber = 7 THEN 'other' ELSE 'read_only' END END AS classification,
    ['none', 'auto_rollback', 'manual_approval', 'human_intervention'][l_suppkey % 4 + 1] AS strategy FROM lineitem)
SELECT binding_id,
  CASE WHEN classification = 'other' THEN 'deny'
    WHEN classification = 'read_only' THEN CASE WHEN strategy <> 'none' THEN 'deny' ELSE 'allow' END
    WHEN l_partkey % 10 = 0 OR q = 50 THEN 'deny'
    WHEN strategy = 'auto_rollback' AND (q % 5 = 0 OR q % 7 = 0) THEN 'deny'
    WHEN strategy = 'manual_approval' AND (q % 5 = 0 OR q % 7 = 0) THEN 'deny'
    WHEN strategy = 'human_intervention' AND (q % 5 = 0 OR q % 7 = 0) THEN 'deny'
    WHEN strategy = 'none' THEN 'deny'
    WHEN (classification = 'destructive_write' OR q % 3 = 0 OR strategy <> 'auto_rollback') AND l_orderkey % 2 = 0 THEN 'require_approval'
    ELSE 'allow' END AS decision,
  CASE WHEN classification = 'other' THEN 'unknown_classification'
    WHEN classification = 'read_only' THEN CASE WHEN strategy <> 'none' THEN 'read_only_with_recovery' ELSE 'read_only' END
    WHEN l_partkey % 10 = 0 OR q = 50 THEN 'no_effect_identity'
    WHEN strategy = 'auto_rollback' AND (q % 5 = 0 OR q % 7 = 0) THEN 'rollback_incomplete'
    WHEN strategy = 'manual_approval' AND (q % 5 = 0 OR q % 7 = 0) THEN 'approval_incomplete'
    WHEN strategy = 'human_intervention' AND (q % 5 = 0 OR q % 7 = 0) THEN 'intervention_incomplete'
    WHEN strategy = 'none' THEN 'no_recovery_strategy'
    WHEN (classification = 'destructive_write' OR q % 3 = 0 OR strategy <> 'auto_rollback') AND l_orderkey % 2 = 0 THEN 'approval_missing'
    ELSE 'write_contract_passed' END AS reason
FROM b""")
def _(t):
    q = F.col("l_quantity").cast("int")
    strategies = F.array(*[F.lit(x) for x in ["none", "auto_rollback", "manual_approval", "human_intervention"]])
    text = F.lit("set")
    bindings = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("binding_id"),
        F.when(F.col("l_returnflag") == "A", "bounded_write").when(F.col("l_returnflag") == "R", "destructive_write")
        .when(F.col("l_linenumber") == 7, "other").otherwise("read_only").alias("classification"),
        F.element_at(strategies, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("strategy"),
        F.when(q == 50, "none").otherwise("table").alias("resource_kind"),
        F.when(F.col("l_partkey") % 10 != 0, text).alias("resource_name"),
        text.alias("primary_key_template"), text.alias("lock_key_template"),
        (q % 5 != 0).alias("rollback_complete"), (q % 7 != 0).alias("idempotent"),
        F.when(q % 5 != 0, text).alias("approval_policy"), F.when(q % 7 != 0, text).alias("review_schema"),
        F.when(q % 5 != 0, text).alias("escalation_queue"), F.when(q % 7 != 0, text).alias("operator_instructions"),
        (q % 3 == 0).alias("approval_required"), (F.col("l_orderkey") % 2 == 1).alias("approved"),
    )
    return L.policy_decisions(bindings)

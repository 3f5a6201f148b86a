"""Run-event ledger: sequence, validity, status, recovery and evidence.

Ledger columns: event_id, run_id, sequence, schema_version, event_type, occurred_at,
skill_name, skill_version, action_id, idempotency_key, reason, reason_code.

A single run may own a large share of all events, so a whole run is never sorted
in one task: per-run facts come from hash aggregates with map-side partials
(``min_by``, ``max_by``, conditional extremes); positions come from ``numbered``.
Joins back to derived rows rely on AQE, which splits skewed partitions of the big
side; ``spread_join`` serves where the rows come straight from a scan, because it
reads them a second time to find the hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import ledger_values as V
from skein.operators.skew import numbered, spread_join, top_n


def lookup(values: dict[str, str], key: Column) -> Column:
    """Literal map lookup that gives null for unknown keys."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def with_sequence(events: DataFrame, bucket: str = "second") -> DataFrame:
    """Position of each event in its run by (occurred_at, event_id)."""
    return numbered(events, ["run_id"], ["occurred_at", "event_id"], F.date_trunc(bucket, "occurred_at"), "sequence")


def scan_by_skill(events: DataFrame, skill_name: str, skill_version: str | None = None) -> DataFrame:
    """Events of one skill (and version) in ledger order."""
    found = events.where(F.col("skill_name") == skill_name)
    if skill_version is not None:
        found = found.where(F.col("skill_version") == skill_version)
    return found.orderBy("occurred_at", "run_id", "sequence")


def scan_by_run(events: DataFrame, run_id: str) -> DataFrame:
    return events.where(F.col("run_id") == run_id).orderBy("sequence")


def stream_violations(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Every broken stream rule per run, one row each."""
    status = lookup(V.STATUS_BY_EVENT, F.col("event_type"))
    at = F.col("sequence")
    facts = events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(at).alias("first_seq"),
        F.max(at).alias("last_seq"),
        F.min_by("event_type", at).alias("first_type"),
        F.max_by(status, F.when(status.isNotNull(), at)).alias("projected"),
        F.min("skill_name").alias("min_name"),
        F.max("skill_name").alias("max_name"),
        F.min("skill_version").alias("min_version"),
        F.max("skill_version").alias("max_version"),
        F.count_if(F.col("schema_version") != V.EVENT_SCHEMA_VERSION).alias("odd_schema"),
        *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in V.UNIQUE_TERMINAL_EVENTS],
    )
    repeated = duplicate_positions(events).groupBy("run_id").agg(F.lit(True).alias("repeats"))
    state = runs.select(
        "run_id", F.col("skill_name").alias("run_skill"), F.col("skill_version").alias("run_version"), "status"
    )
    j = state.join(facts, "run_id", "left").join(repeated, "run_id", "left")
    gaps = (F.col("first_seq") != 1) | (F.col("last_seq") != F.col("n")) | F.coalesce("repeats", F.lit(False))
    twice = F.greatest(*[F.col(f"n_{t}") for t in V.UNIQUE_TERMINAL_EVENTS]) > 1
    other = (
        (F.col("min_name") != F.col("run_skill")) | (F.col("max_name") != F.col("run_skill"))
        | (F.col("min_version") != F.col("run_version")) | (F.col("max_version") != F.col("run_version"))
    )
    checks = {
        "no_events": F.col("n").isNull(),
        "sequence_not_contiguous": gaps,
        "must_begin_with_run_created": F.col("first_type") != "run_created",
        "duplicate_terminal": twice,
        "skill_identity_mismatch": other,
        "unsupported_schema_version": F.col("odd_schema") > 0,
        "status_projection_mismatch": F.col("n").isNotNull() & ~F.col("projected").eqNullSafe(F.col("status")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return j.select("run_id", F.explode(found).alias("violation"))


def illegal_events(events: DataFrame) -> DataFrame:
    """Events after the final terminal, or not allowed after the outcome."""
    at = F.col("sequence")
    return events_past_marks(events, stream_marks(events, F.col("sequence")), at)


def stream_marks(events: DataFrame, at: Column) -> DataFrame:
    """First final terminal and first outcome of each run; batch or streaming."""
    kind = F.col("event_type")
    return events.where(kind.isin(*V.FINAL_EVENTS, *V.OUTCOME_EVENTS)).groupBy("run_id").agg(
        F.min(F.when(kind.isin(*V.FINAL_EVENTS), at)).alias("final_at"),
        F.min(F.when(kind.isin(*V.OUTCOME_EVENTS), at)).alias("outcome_at"),
    )


def events_past_marks(events: DataFrame, limits: DataFrame, at: Column) -> DataFrame:
    kind = F.col("event_type")
    reason = (
        F.when(at > F.col("final_at"), "after_final_terminal")
        .when((at > F.col("outcome_at")) & ~kind.isin(*V.ALLOWED_AFTER_OUTCOME), "invalid_after_outcome")
    )
    return (
        events.join(limits, "run_id").withColumn("violation", reason)
        .where(F.col("violation").isNotNull())
        .select("run_id", "event_id", at.alias("sequence"), "event_type", "violation")
    )


def projected_status(events: DataFrame) -> DataFrame:
    """Status of the last event that maps to one."""
    status = lookup(V.STATUS_BY_EVENT, F.col("event_type"))
    return (
        events.select("run_id", "sequence", status.alias("status"))
        .where(F.col("status").isNotNull())
        .groupBy("run_id")
        .agg(F.max_by("status", "sequence").alias("status"))
    )


def claim_results(claims: DataFrame) -> DataFrame:
    """The first claim of a key creates it; later ones own it or conflict."""
    order = F.struct("claimed_at", "claim_id")
    owner = F.struct("run_id", "action_id", "purpose")
    first = claims.groupBy("idempotency_key").agg(
        F.min_by(owner, order).alias("owner"), F.min(order).getField("claim_id").alias("first_claim")
    )
    result = (
        F.when(F.col("claim_id") == F.col("first_claim"), "created")
        .when(owner.eqNullSafe(F.col("owner")), "owned")
        .otherwise("conflict")
    )
    return spread_join(claims, first, ["idempotency_key"]).withColumn("result", result).drop("owner", "first_claim")


def unfinished_resumes(events: DataFrame) -> DataFrame:
    """Latest resume of a run with no closing event after it."""
    kind = F.col("event_type")
    resume = F.max(F.when(kind == "run_resume_started", F.col("sequence")))
    closed = F.max(F.when(kind.isin(*V.RESUME_CLOSURE_EVENTS), F.col("sequence")))
    return (
        events.groupBy("run_id")
        .agg(resume.alias("resume_sequence"), closed.alias("closed_at"))
        .where(F.col("resume_sequence").isNotNull() & (F.coalesce("closed_at", F.lit(0)) < F.col("resume_sequence")))
        .select("run_id", "resume_sequence")
    )


def ambiguous_actions(events: DataFrame) -> DataFrame:
    """Started actions without an end for the same (action, key) in the run."""
    keys = ["run_id", "action_id", "idempotency_key"]
    started = events.where((F.col("event_type") == "action_started") & F.col("idempotency_key").isNotNull())
    ended = events.where(F.col("event_type").isin(*V.ACTION_END_EVENTS)).select(*keys).distinct()
    return started.join(ended, keys, "left_anti").select("event_id", *keys, "sequence")


def recovery_candidates(events: DataFrame) -> DataFrame:
    """Succeeded actions still to be undone, latest first per run.

    Needs ``strategy`` and ``compensation_key`` columns next to the ledger ones.
    """
    kind = F.col("event_type")
    done = events.where((kind == "action_succeeded") & F.col("strategy").isin(*V.RECOVERY_STRATEGIES))
    confirmed = events.where((kind == "manual_recovery_confirmed") & F.col("action_id").isNotNull())
    undone = events.where((kind == "compensation_succeeded") & F.col("idempotency_key").isNotNull())
    confirmed = confirmed.select("run_id", "action_id").distinct()
    undone = undone.select(
        "run_id", F.col("idempotency_key").alias("undo_key"), F.lit("auto_rollback").alias("undo_strategy")
    ).distinct()
    open_actions = done.join(confirmed, ["run_id", "action_id"], "left_anti")
    auto_key = F.when(F.col("strategy") == "auto_rollback", F.col("compensation_key"))
    keyed = open_actions.withColumn("undo_key", auto_key).withColumn("undo_strategy", F.col("strategy"))
    left = keyed.join(undone, ["run_id", "undo_key", "undo_strategy"], "left_anti")
    return numbered(
        left.select("run_id", "event_id", "action_id", "sequence", "strategy", "occurred_at"),
        ["run_id"], [F.desc("sequence")], F.date_trunc("second", "occurred_at"), "undo_order", descending=True,
    ).drop("occurred_at")


WATCHED = {
    "compensated": "run_compensated",
    "recovery_failed": "run_recovery_failed",
    "reconciliation": "reconciliation_required",
    "suspended": "run_suspended",
    "cancelled": "run_cancelled",
    "queued": "compensation_queued",
    "succeeded": "run_succeeded",
    "failed": "run_failed",
    "denied": "policy_denied",
    "asked": "approval_required",
    "granted": "approval_granted",
}


def run_flags(events: DataFrame) -> DataFrame:
    """Which of the deciding event types each run has seen; batch or streaming."""
    return events.groupBy("run_id", "skill_name", "skill_version").agg(
        *[F.bool_or(F.col("event_type") == kind).alias(f"has_{name}") for name, kind in WATCHED.items()]
    )


def outcomes_of(flags: DataFrame) -> DataFrame:
    has = {name: F.col(f"has_{name}") for name in WATCHED}
    outcome = (
        F.when(has["compensated"], "compensated")
        .when(has["recovery_failed"], "recovery_failed")
        .when(has["reconciliation"], "reconciliation_required")
        .when(has["suspended"], "hitl_required")
        .when(has["cancelled"], "cancelled")
        .when(has["queued"] & ~has["succeeded"], "recovery_pending")
        .when(has["succeeded"], "succeeded")
        .when(has["failed"], "failed")
        .when(has["denied"], "denied")
        .when(has["asked"] & ~has["granted"], "awaiting_approval")
    )
    return flags.select("run_id", "skill_name", "skill_version", outcome.alias("outcome"))


def run_outcomes(events: DataFrame) -> DataFrame:
    """One outcome per run by precedence of the event types seen."""
    return outcomes_of(run_flags(events))


def outcome_counts(events: DataFrame) -> DataFrame:
    return count_outcomes(run_outcomes(events))


def count_outcomes(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes
        .where(F.col("outcome").isNotNull())
        .groupBy("skill_name", "skill_version", "outcome")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def failure_pattern() -> Column:
    """Event type, with the reason code only if it is a safe token."""
    code = F.col("reason_code")
    return F.when(code.rlike(V.SAFE_REASON_CODE), F.concat_ws(":", "event_type", "reason_code")).otherwise(F.col("event_type"))


def failure_patterns(events: DataFrame, by: list[str]) -> DataFrame:
    """Distinct failure patterns as rows, so that no unbounded set is built."""
    reason = F.coalesce("reason", F.lit("")) != ""
    return (
        events.where(F.col("event_type").isin(*V.FAILURE_EVENTS) & reason)
        .select(*by, failure_pattern().alias("pattern"))
        .distinct()
    )


def element_refs(events: DataFrame, by: list[str]) -> DataFrame:
    return events.where(F.coalesce("action_id", F.lit("")) != "").select(*by, "action_id").distinct()


def evidence_summary(events: DataFrame, minimum_sample: int = 10) -> DataFrame:
    """Counts, success rate and confidence per skill and version.

    The sets of failure patterns and element references grow with the data, so the
    summary carries their sizes; ``failure_patterns`` and ``element_refs`` hold the rows.
    """
    by = ["skill_name", "skill_version"]
    counts = run_outcomes(events).groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == name).alias(name) for name in V.OUTCOMES]
    )
    totals = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("source_event_watermark"), F.max("occurred_at").alias("generated_at")
    )
    patterns = failure_patterns(events, by).groupBy(*by).agg(F.count(F.lit(1)).alias("failure_patterns"))
    refs = element_refs(events, by).groupBy(*by).agg(F.count(F.lit(1)).alias("element_refs"))
    sample = sum((F.col(name) for name in V.SAMPLED_OUTCOMES), F.lit(0).cast("long"))
    return (
        totals.join(counts, by).join(patterns, by, "left").join(refs, by, "left")
        .withColumn("sample_size", sample)
        .withColumn("success_rate", F.when(F.col("sample_size") > 0, F.round(F.col("succeeded") / F.col("sample_size"), 6)))
        .withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("sample_size") / F.lit(max(1, minimum_sample))), 6))
        .fillna(0, ["failure_patterns", "element_refs"])
    )


def run_evidence(events: DataFrame) -> DataFrame:
    """Evidence per run with its last event and first preflight attestation."""
    at = F.col("sequence")
    preflight = F.col("event_type") == "preflight_passed"
    return (
        events.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.max(at).alias("watermark"),
            F.max_by("event_type", at).alias("last_event_type"),
            F.max_by("occurred_at", at).alias("generated_at"),
            F.min_by("governance_ref", F.when(preflight, at)).alias("governance_ref"),
        )
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Events per run and type."""
    return events.groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("events"))


def runs_with_event(runs: DataFrame, events: DataFrame, event_type: str, key: str | None = None) -> DataFrame:
    """Runs for which such an event exists."""
    found = events.where(F.col("event_type") == event_type)
    if key is not None:
        found = found.where(F.col("idempotency_key") == key)
    return runs.join(found.select("run_id").distinct(), "run_id", "left_semi")


def expires_at(created: Column, ttl_seconds: int) -> Column:
    """End of the approval window."""
    return created + F.make_dt_interval(secs=F.lit(ttl_seconds))


def effective_status(now: Column) -> Column:
    """Pending or approved items past their window (or without one) are expired."""
    late = F.col("expires_at").isNull() | (F.col("expires_at") <= now)
    return F.when(F.col("status").isin("pending", "approved") & late, "expired").otherwise(F.col("status"))


def approval_queue(items: DataFrame, now: Column, status: str | None = None, *, limit: int) -> DataFrame:
    """Items with the derived status, then the status filter, then the first page."""
    found = items.withColumn("status", effective_status(now))
    if status is not None:
        found = found.where(F.col("status") == status)
    return found.orderBy("created_at", "item_id").limit(limit)


def pending_once(items: DataFrame) -> DataFrame:
    """One pending item per (run, action, kind), the earliest; others unchanged."""
    keys = ["run_id", "action_id", "kind"]
    pending = top_n(items.where(F.col("status") == "pending"), keys, ["created_at", "item_id"], 1).drop("rank")
    return pending.unionByName(items.where(F.col("status") != "pending"))


def decision_violations(decisions: DataFrame, items: DataFrame, runs: DataFrame, bases: DataFrame) -> DataFrame:
    """Decisions that do not fit their item, the run status or the execution basis."""
    allowed = F.lit(False)
    for kind, options in V.ALLOWED_DECISIONS.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("decision").isin(*options))
    wanted = F.when(F.col("kind") == "action_approval", "awaiting_approval").otherwise("hitl_required")
    j = (
        decisions.join(items.select("item_id", "run_id", "kind", "basis_digest"), "item_id", "left")
        .join(runs.select("run_id", F.col("status").alias("run_status")), "run_id", "left")
        .join(bases.select("run_id", "execution_digest"), "run_id", "left")
    )
    checks = {
        "item_missing": F.col("kind").isNull(),
        "decision_not_allowed": F.col("kind").isNotNull() & ~allowed,
        "run_not_awaiting": F.col("kind").isNotNull() & ~F.coalesce(F.col("run_status") == wanted, F.lit(False)),
        "basis_mismatch": F.col("kind").isNotNull() & ~F.coalesce(F.col("execution_digest") == F.col("basis_digest"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return j.select("decision_id", "item_id", F.explode(found).alias("violation"))


def certified_requests(requests: DataFrame, allowed: DataFrame, scope: list[str]) -> DataFrame:
    """A request passes if it asks for something and all of it is in the allowed scope."""
    marked = spread_join(requests, allowed.select(*scope).distinct().withColumn("ok", F.lit(True)), scope, "left")
    return marked.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("ok").isNull()).alias("outside"),
    ).withColumn("certified", (F.col("requested") > 0) & (F.col("outside") == 0))


def duplicate_positions(events: DataFrame) -> DataFrame:
    """Q1: (run, sequence) pairs used more than once."""
    return events.groupBy("run_id", "sequence").agg(F.count(F.lit(1)).alias("events")).where(F.col("events") > 1)


def orphans(children: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """Q2: runs named by a child table but missing from ``runs``, with their row counts."""
    ids = runs.select("run_id")
    parts = [
        df.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).join(ids, "run_id", "left_anti")
        .select(F.lit(name).alias("child"), "run_id", "rows")
        for name, df in children.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def domain_violations(df: DataFrame, domains: dict[str, tuple]) -> DataFrame:
    """Q3: values outside a column's domain, with counts; null is outside."""
    bad = [
        F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)),
               F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")))
        for c, values in domains.items()
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*bad))).alias("v"))
        .groupBy("v.field", "v.value").agg(F.count(F.lit(1)).alias("rows"))
    )


def decision_agreement(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Q4: items with more than one decision, or a status the decision does not explain."""
    per_item = decisions.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.min_by("decision", F.struct("decided_at", "decision_id")).alias("decision"),
    )
    agreed = lookup(V.HITL_DECISIONS, F.col("decision"))
    j = items.select("item_id", "status").join(per_item, "item_id")
    checks = F.array_compact(F.array(
        F.when(F.col("decisions") > 1, F.lit("several_decisions")),
        F.when(~agreed.eqNullSafe(F.col("status")), F.lit("status_mismatch")),
    ))
    return j.select("item_id", F.explode(checks).alias("violation"))


def changed_history(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """U8: rows of the earlier snapshot that the later one no longer holds unchanged."""
    return earlier.exceptAll(later)


def key_from_template(template: str, tokens: dict[str, Column]) -> Column:
    """Fill ``{token}`` places; null where a value is missing or a token is unknown."""
    out = F.lit(template)
    for name, value in tokens.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return F.when(~out.rlike("[{}]") & (out != ""), out)


def json_pointer(document: Column, pointer: str) -> Column:
    """Value at an RFC 6901 pointer, null where the path does not exist."""
    if pointer == "":
        return document
    if not pointer.startswith("/"):
        raise ValueError(f"pointer must start with '/': {pointer!r}")
    path = "$"
    for raw in pointer.split("/")[1:]:
        part = raw.replace("~1", "/").replace("~0", "~")
        path += f"[{part}]" if part.isdigit() else f"['{part}']"
    return F.get_json_object(document, path)


def policy_decisions(bindings: DataFrame) -> DataFrame:
    """Allow, deny or require approval for each action binding, first rule wins.

    Columns: binding_id, classification, strategy, resource_kind, resource_name,
    primary_key_template, lock_key_template, rollback_complete, idempotent,
    approval_policy, review_schema, escalation_queue, operator_instructions,
    approval_required, approved.
    """
    c = F.col

    def blank(name: str) -> Column:
        return F.coalesce(c(name), F.lit("")) == ""

    write = c("classification").isin("bounded_write", "destructive_write")
    no_identity = (
        F.coalesce(c("resource_kind"), F.lit("none")).isin("none")
        | blank("resource_name") | blank("primary_key_template") | blank("lock_key_template")
    )
    strategy = F.coalesce(c("strategy"), F.lit(""))
    needs_person = (
        (c("classification") == "destructive_write") | F.coalesce(c("approval_required"), F.lit(False))
        | strategy.isin("manual_approval", "human_intervention")
    )
    rules = [
        (~F.coalesce(write | (c("classification") == "read_only"), F.lit(False)), "deny", "unknown_classification"),
        ((c("classification") == "read_only") & (strategy != "none"), "deny", "read_only_with_recovery"),
        (c("classification") == "read_only", "allow", "read_only"),
        (no_identity, "deny", "no_effect_identity"),
        ((strategy == "auto_rollback") & ~(c("rollback_complete") & c("idempotent")), "deny", "rollback_incomplete"),
        ((strategy == "manual_approval") & (blank("approval_policy") | c("review_schema").isNull()), "deny", "approval_incomplete"),
        ((strategy == "human_intervention") & (blank("escalation_queue") | blank("operator_instructions")), "deny", "intervention_incomplete"),
        (~strategy.isin("auto_rollback", "manual_approval", "human_intervention"), "deny", "no_recovery_strategy"),
        (needs_person & ~F.coalesce(c("approved"), F.lit(False)), "require_approval", "approval_missing"),
    ]
    decision, reason = F, F
    for test, verdict, why in rules:
        decision = decision.when(test, verdict)
        reason = reason.when(test, why)
    return bindings.select(
        "binding_id", decision.otherwise("allow").alias("decision"), reason.otherwise("write_contract_passed").alias("reason")
    )

"""Golden cases of the run-event ledger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.operators import ledger as L

SCHEMA = (
    "event_id long, run_id string, sequence long, schema_version string, event_type string, occurred_at timestamp_ntz, "
    "skill_name string, skill_version string, action_id string, idempotency_key string, reason string, reason_code string, governance_ref string"
)


def stream(spark, **runs):
    """runs: name -> list of event types, or (type, reason, code) tuples."""
    rows, at = [], dt.datetime(2024, 1, 1)
    for run, kinds in runs.items():
        for place, kind in enumerate(kinds, 1):
            kind, reason, code = kind if isinstance(kind, tuple) else (kind, None, None)
            rows.append((len(rows), run, place, "4.0.0", kind, at + dt.timedelta(seconds=len(rows)), "s", "1", "a_001", None, reason, code, None))
    return spark.createDataFrame(rows, SCHEMA)


def summary(spark, minimum=10, **runs):
    return L.evidence_summary(stream(spark, **runs), minimum).first().asDict()


def test_counts(spark):
    s = summary(spark, 2, a=["run_created", "run_succeeded"], b=["run_created", ("run_failed", "x", None)])
    assert (s["succeeded"], s["failed"], s["success_rate"], s["confidence"]) == (1, 1, 0.5, 1.0)


def test_compensated_wins(spark):
    s = summary(spark, a=["run_created", "run_succeeded", "run_compensated"])
    assert (s["compensated"], s["succeeded"], s["source_event_watermark"]) == (1, 0, 3)


def test_reason_text_stays_inside(spark):
    e = stream(spark, a=["run_created", ("run_failed", "secret-value", "secret value"), "run_compensated"])
    assert [r.pattern for r in L.failure_patterns(e, ["skill_name"]).collect()] == ["run_failed"]
    e = stream(spark, a=[("run_failed", "secret", "E_DISK")])
    assert [r.pattern for r in L.failure_patterns(e, ["skill_name"]).collect()] == ["run_failed:E_DISK"]


def test_control_states(spark):
    s = summary(spark, a=["approval_required"], b=["run_suspended"], c=["reconciliation_required"])
    assert (s["awaiting_approval"], s["hitl_required"], s["reconciliation_required"]) == (1, 1, 1)
    assert (s["sample_size"], s["confidence"], s["success_rate"]) == (0, 0.0, None)


def test_granted_approval(spark):
    s = summary(spark, a=["approval_required", "approval_granted", "run_succeeded"])
    assert (s["succeeded"], s["awaiting_approval"]) == (1, 0)


@pytest.mark.parametrize("kinds, outcome", [
    (["policy_denied"], "denied"), (["run_cancelled"], "cancelled"), (["run_failed", "compensation_queued"], "recovery_pending"),
])
def test_unsampled(spark, kinds, outcome):
    s = summary(spark, a=kinds)
    assert s[outcome] == 1 and s["sample_size"] == 0


def violations(spark, events, status="succeeded", name="s"):
    runs = spark.createDataFrame([("a", name, "1", status)], "run_id string, skill_name string, skill_version string, status string")
    return {r.violation for r in L.stream_violations(events, runs).collect()}


def test_valid_stream(spark):
    assert violations(spark, stream(spark, a=["run_created", "run_succeeded"])) == set()


def test_stream_violations(spark):
    good = stream(spark, a=["run_created", "action_started", "run_succeeded"])
    assert violations(spark, good.where("sequence <> 2")) == {"sequence_not_contiguous"}
    assert violations(spark, good, "failed") == {"status_projection_mismatch"}
    assert violations(spark, good, name="other") == {"skill_identity_mismatch"}
    assert violations(spark, good.withColumn("schema_version", F.lit("3"))) == {"unsupported_schema_version"}
    assert violations(spark, good.where("false")) == {"no_events"}
    assert "must_begin_with_run_created" in violations(spark, good.withColumn("event_type", F.lit("action_started")))
    twice = stream(spark, a=["run_created", "run_succeeded", "run_succeeded"])
    assert violations(spark, twice) == {"duplicate_terminal"}
    repeated = good.unionByName(good.where("sequence = 2"))
    assert "sequence_not_contiguous" in violations(spark, repeated)


def test_illegal_events(spark):
    e = stream(
        spark, a=["run_created", "run_cancelled", "action_started"], b=["run_succeeded", "compensation_queued", "action_started", "run_failed"],
        c=["run_created", "approval_rejected"])
    got = {(r.run_id, r.sequence, r.violation) for r in L.illegal_events(e).collect()}
    assert got == {("a", 3, "after_final_terminal"), ("b", 3, "invalid_after_outcome"), ("b", 4, "invalid_after_outcome")}


def test_claims(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "r1", "a", "p", "k", at), (2, "r1", "a", "p", "k", at), (3, "r2", "a", "p", "k", at)]
    claims = spark.createDataFrame(rows, "claim_id long, run_id string, action_id string, purpose string, idempotency_key string, claimed_at timestamp_ntz")
    assert {r.claim_id: r.result for r in L.claim_results(claims).collect()} == {1: "created", 2: "owned", 3: "conflict"}


def test_resume_and_ambiguous(spark):
    e = stream(spark, a=["run_resume_started", "action_started"], b=["run_resume_started", "run_suspended"], c=["action_started", "action_failed"])
    assert [r.run_id for r in L.unfinished_resumes(e).collect()] == ["a"]
    keyed = e.withColumn("idempotency_key", F.lit("k"))
    assert [r.run_id for r in L.ambiguous_actions(keyed).collect()] == ["a"]


def test_recovery(spark):
    e = stream(spark, a=["action_succeeded", "action_succeeded", "action_succeeded", "compensation_succeeded"])
    e = e.withColumn("strategy", F.when(F.col("sequence") == 1, "manual_approval").otherwise("auto_rollback"))
    e = e.withColumn("compensation_key", F.concat(F.lit("k"), "sequence")).withColumn("idempotency_key", F.when(F.col("sequence") == 4, "k2"))
    got = [(r.sequence, r.undo_order) for r in L.recovery_candidates(e).orderBy("undo_order").collect()]
    assert got == [(3, 1), (1, 2)]


def test_expiry(spark):
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    rows = [(1, "pending", None), (2, "approved", dt.datetime(2024, 1, 1)), (3, "rejected", None), (4, "pending", dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "id long, status string, expires_at timestamp_ntz").withColumn("status", L.effective_status(now))
    assert {r.id: r.status for r in df.collect()} == {1: "expired", 2: "expired", 3: "rejected", 4: "pending"}


def test_templates_and_pointers(spark):
    df = spark.createDataFrame([('{"a/b": {"c": [10, 20]}, "m~n": 8}', "r1")], "doc string, run string")
    doc = F.col("doc")
    got = df.select(
        L.json_pointer(doc, "/a~1b/c/1").alias("x"), L.json_pointer(doc, "/m~0n").alias("y"), L.json_pointer(doc, "/none").alias("z"),
        L.key_from_template("run/{run_id}", {"run_id": F.col("run")}).alias("k"), L.key_from_template("{run_id}/{other}", {"run_id": F.col("run")}).alias("bad"),
    ).first()
    assert tuple(got) == ("20", "8", None, "run/r1", None)


def test_snapshot_history(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "n")], "id long, v string")
    assert [tuple(r) for r in L.changed_history(a, b).collect()] == [(2, "y")]

"""Vocabulary of the run-event ledger."""

# They must equal the ledger contract for results to agree.

STATUS_BY_EVENT = {
    "run_created": "created",
    "plan_created": "planned",
    "preflight_passed": "preflight",
    "policy_allowed": "ready",
    "policy_denied": "denied",
    "approval_required": "awaiting_approval",
    "approval_granted": "ready",
    "approval_rejected": "denied",
    "run_resume_started": "running",
    "action_prepared": "ready",
    "action_started": "running",
    "action_outcome_unknown": "reconciliation_required",
    "validation_succeeded": "validating",
    "validation_failed": "failed",
    "action_failed": "failed",
    "compensation_queued": "recovery_pending",
    "compensation_started": "compensating",
    "compensation_retry_scheduled": "compensating",
    "compensation_succeeded": "compensating",
    "compensation_failed": "compensating",
    "reconciliation_required": "reconciliation_required",
    "run_succeeded": "succeeded",
    "run_failed": "failed",
    "run_compensated": "compensated",
    "run_recovery_failed": "recovery_failed",
    "run_suspended": "hitl_required",
    "manual_recovery_confirmed": "recovery_pending",
    "run_cancelled": "cancelled",
}

UNIQUE_TERMINAL_EVENTS = (
    "run_succeeded",
    "run_failed",
    "run_compensated",
    "run_recovery_failed",
    "run_cancelled",
)

OUTCOME_EVENTS = ("run_succeeded", "run_failed")

FINAL_EVENTS = ("run_compensated", "run_cancelled", "approval_rejected")

ALLOWED_AFTER_OUTCOME = (
    "compensation_queued",
    "compensation_started",
    "compensation_retry_scheduled",
    "compensation_succeeded",
    "compensation_failed",
    "reconciliation_required",
    "approval_required",
    "approval_granted",
    "approval_rejected",
    "run_compensated",
    "run_recovery_failed",
    "run_suspended",
    "manual_recovery_confirmed",
    "run_cancelled",
)

RESUME_CLOSURE_EVENTS = (
    "approval_required",
    "policy_denied",
    "reconciliation_required",
    "run_succeeded",
    "run_failed",
    "run_suspended",
    "run_cancelled",
)

ACTION_END_EVENTS = ("action_succeeded", "action_failed", "action_outcome_unknown")

FAILURE_EVENTS = ("run_failed", "run_recovery_failed", "run_suspended", "reconciliation_required")

RECOVERY_STRATEGIES = ("auto_rollback", "manual_approval", "human_intervention")

OUTCOMES = (
    "succeeded",
    "failed",
    "compensated",
    "recovery_failed",
    "awaiting_approval",
    "hitl_required",
    "reconciliation_required",
    "recovery_pending",
    "denied",
    "cancelled",
)

SAMPLED_OUTCOMES = ("succeeded", "failed", "compensated", "recovery_failed")

EVENT_SCHEMA_VERSION = "4.0.0"

SAFE_REASON_CODE = "^[A-Z][A-Z0-9_]{1,63}$"

HITL_KINDS = ("action_approval", "manual_recovery")
HITL_STATUSES = ("pending", "approved", "rejected", "confirmed", "expired")
HITL_DECISIONS = {"approve": "approved", "reject": "rejected", "confirm_recovered": "confirmed"}
ALLOWED_DECISIONS = {
    "action_approval": ("approve", "reject"),
    "manual_recovery": ("confirm_recovered", "reject"),
}

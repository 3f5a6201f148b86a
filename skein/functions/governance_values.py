"""Vocabulary of the governance store."""

# They must equal the store contract for results to agree.

RISK_LEVELS = ("safe", "low", "medium", "high", "critical", "blocked")
STATUSES = ("pending", "approved", "rejected", "blocked")
RESCAN_LEVELS = ("high", "critical", "blocked")

# Revisioned attributes: the current revision wins over the skill row.
REVISIONED = (
    "version",
    "status",
    "source_type",
    "source_url",
    "source_commit",
    "source_path",
    "original_format",
    "fetched_at",
    "converted_at",
    "converter_version",
    "target_format",
    "security_scanned_at",
    "scanner_version",
    "risk_level",
    "risk_score",
    "approved_by",
    "approved_at",
    "equivalence_tested_at",
    "equivalence_score",
    "equivalence_passed",
    "installed_path",
    "installed_at",
    "updated_at",
)

# Provenance fields of the source checksum, in key order.
CHECKSUM_FIELDS = (
    "converted_at",
    "fetched_at",
    "source_commit",
    "source_path",
    "source_type",
    "source_url",
    "version",
)

ITEM_STATUSES = ("queued", "running", "succeeded", "failed", "retrying", "skipped", "cancelled")
NON_RETRIABLE = (
    "PATH_NOT_FOUND",
    "SOURCE_PATH_MISSING",
    "SOURCE_PATH_NOT_ALLOWED",
    "INSTALLED_PATH_MISSING",
    "INSTALLED_PATH_NOT_ALLOWED",
)
SOURCE_PATH_ERRORS = ("PATH_NOT_FOUND", "SOURCE_PATH_MISSING", "SOURCE_PATH_NOT_ALLOWED")
INSTALLED_PATH_ERRORS = ("INSTALLED_PATH_MISSING", "INSTALLED_PATH_NOT_ALLOWED")

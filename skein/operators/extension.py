"""Places where callers plug in their own logic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_rules(rows: DataFrame, rules: dict[str, str], keep: list[str]) -> DataFrame:
    """Rules as SQL conditions by id; one row per row and rule with its verdict (null counts as failed)."""
    verdicts = [F.struct(F.lit(name).alias("rule_id"), F.coalesce(F.expr(sql), F.lit(False)).alias("passed")) for name, sql in rules.items()]
    return rows.select(*keep, F.explode(F.array(*verdicts)).alias("v")).select(*keep, "v.rule_id", "v.passed")


def apply_policy(bindings: DataFrame, policy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A policy is a function from bindings to (binding_id, decision, reason)."""
    decided = bindings.transform(policy)
    missing = {"binding_id", "decision", "reason"} - set(decided.columns)
    if missing:
        raise ValueError(f"the policy leaves out {sorted(missing)}")
    return decided


def revisions_from(reader: Callable[[], DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """A repository is a reader that returns the revision columns."""
    found = reader()
    missing = set(columns) - set(found.columns)
    if missing:
        raise ValueError(f"the repository leaves out {sorted(missing)}")
    return found.select(*columns)

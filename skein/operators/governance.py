"""Governance store: projections, lists, audit, revisions, scans, jobs and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import governance_values as V
from skein.operators.skew import numbered, spread_join, top_n, with_previous

FINDINGS = (
    "array<struct<rule_id:string,rule_name:string,severity:string,original_severity:string,adjusted_severity:string,"
    "line_number:int,line_content:string,file_path:string,severity_changed:boolean,context_type:string,"
    "in_code_block:boolean,code_block_language:string>>"
)


def current_revision(skills: DataFrame, revisions: DataFrame, how: str = "left") -> DataFrame:
    """Each skill with its current revision; both sides hold one row per key."""
    r = revisions.select(*[F.col(c).alias(f"rev_{c}") for c in revisions.columns])
    return skills.join(r, F.col("current_revision_id") == F.col("rev_revision_id"), how)


def effective_skills(skills: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every revisioned attribute from the current revision, else from the skill row."""
    j = current_revision(skills, revisions)
    own = set(skills.columns)
    columns = []
    for c in skills.columns:
        if c in V.REVISIONED and f"rev_{c}" in j.columns:
            columns.append(F.coalesce(f"rev_{c}", c).alias(c))
        else:
            columns.append(F.col(c))
    extra = [c for c in ("revision_id", "revision_number", "source_checksum", "artifact_digest") if f"rev_{c}" in j.columns and c not in own]
    return j.select(*columns, *[F.col(f"rev_{c}").alias(c) for c in extra])


def list_skills(effective: DataFrame, status: str | None = None, risk_level: str | None = None, *, limit: int) -> DataFrame:
    """Newest update first; the filters see effective values."""
    if status is not None:
        effective = effective.where(F.col("status") == status)
    if risk_level is not None:
        effective = effective.where(F.col("risk_level") == risk_level)
    return effective.orderBy(F.desc("updated_at"), "skill_id").limit(limit)


SORTS = {
    "name": lambda: F.lower("name"),
    "risk_score": lambda: F.col("risk_score"),
    "status": lambda: F.col("status"),
    "updated_at": lambda: F.col("updated_at"),
}


def matching_skills(effective: DataFrame, search: str | None) -> DataFrame:
    if not search:
        return effective
    needle = F.lit(search.lower())
    return effective.where(F.lower("name").contains(needle) | F.lower("author_name").contains(needle))


def dashboard_page(
    effective: DataFrame, search: str | None = None, sort_by: str = "updated_at",
    descending: bool = True, page: int = 1, page_size: int = 20,
) -> DataFrame:
    """Substring search, one sort, one page; the filter comes before paging."""
    key = SORTS[sort_by]()
    ordered = matching_skills(effective, search).orderBy(key.desc() if descending else key.asc(), "skill_id")
    return ordered.offset((page - 1) * page_size).limit(page_size)


def page_counts(df: DataFrame, page_size: int) -> DataFrame:
    """Total rows and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(page_size)))


def by_category(documents: DataFrame, category: str, limit: int) -> DataFrame:
    """Documents of one category, first by id."""
    return documents.where(F.col("category") == category).orderBy("id").limit(limit)


def audit_query(
    log: DataFrame, skill_id=None, event_type: str | None = None, start: Column | None = None,
    end: Column | None = None, page: int = 1, page_size: int = 50,
) -> DataFrame:
    """Newest first; both ends of the range are inclusive; bad JSON gives null details."""
    if skill_id is not None:
        log = log.where(F.col("skill_id") == skill_id)
    if event_type is not None:
        log = log.where(F.col("event_type") == event_type)
    if start is not None:
        log = log.where(F.col("ts") >= start)
    if end is not None:
        log = log.where(F.col("ts") <= end)
    page_rows = log.orderBy(F.desc("ts"), F.desc("event_id")).offset((page - 1) * page_size).limit(page_size)
    return page_rows.withColumn("details", F.try_variant_get(F.try_parse_json("details_json"), "$.k", "bigint"))


def review_bucket() -> Column:
    """Quick approvals (safe, low) against those that need a reader."""
    return (
        F.when(F.col("risk_level").isin("safe", "low"), "quick")
        .when(F.col("risk_level").isin("medium", "high", "critical"), "careful")
        .otherwise("other")
    )


def review_queue(effective: DataFrame, limit: int) -> DataFrame:
    return list_skills(effective, status="pending", limit=limit).withColumn("bucket", review_bucket())


def rescan_candidates(effective: DataFrame) -> DataFrame:
    """P10: skills whose risk calls for another scan."""
    return effective.where(F.col("risk_level").isin(*V.RESCAN_LEVELS))


def scan_candidates(effective: DataFrame, force: bool = False) -> DataFrame:
    return effective if force else effective.where(F.col("status") == "pending")


def untested(effective: DataFrame) -> DataFrame:
    return effective.where(F.col("equivalence_score").isNull())


def action_readiness(effective: DataFrame, inventory: DataFrame) -> DataFrame:
    """What can run for a skill, from the paths present, with reasons when not."""
    paths = inventory.select("path").distinct()
    j = (
        effective.join(paths.select(F.col("path").alias("source_path"), F.lit(True).alias("has_source")), "source_path", "left")
        .join(paths.select(F.col("path").alias("installed_path"), F.lit(True).alias("has_installed")), "installed_path", "left")
    )
    source = F.coalesce("has_source", F.lit(False))
    installed = F.coalesce("has_installed", F.lit(False))

    def missing(name: str, present: Column) -> Column:
        unset = F.coalesce(name, F.lit("")) == ""
        return F.when(~present & unset, F.lit(f"{name} is not set")).when(
            ~present, F.concat(F.lit(f"{name} does not exist: "), F.col(name))
        )

    reasons = F.array_compact(F.array(missing("source_path", source), missing("installed_path", installed)))
    return j.select(
        "skill_id", source.alias("can_scan"), (source & installed).alias("can_test"),
        F.array_join(reasons, "; ").alias("reasons"),
    )


def sync_plan(available: DataFrame, installed: DataFrame, pattern: str | None = None) -> DataFrame:
    """Install or skip with the first reason that applies."""
    j = available.join(installed.select("name").distinct().withColumn("here", F.lit(True)), "name", "left")
    mismatch = F.lit(False) if pattern is None else ~F.col("name").contains(pattern)
    reason = (
        F.when(~F.col("valid"), "Invalid skill structure")
        .when(mismatch, f"Name doesn't match pattern '{pattern}'")
        .when(F.col("here"), "Already installed")
    )
    return j.select("name", F.when(reason.isNull(), "install").otherwise("skip").alias("action"), reason.alias("reason"))


def parsed_findings(raw: Column) -> Column:
    """Findings array of a scan; missing or broken JSON is an empty array."""
    return F.coalesce(F.from_json(raw, FINDINGS), F.from_json(F.lit("[]"), FINDINGS))


def normalised_findings(scans: DataFrame) -> DataFrame:
    """One row per finding, with defaults and the adjusted severity where there is one."""
    f = F.col("f")

    def either(name: str, default: str) -> Column:
        return F.coalesce(f[name], F.lit(default))

    return scans.select("scan_id", F.posexplode(parsed_findings(F.col("findings_json"))).alias("position", "f")).select(
        "scan_id",
        F.col("position").cast("long").alias("position"),
        either("rule_id", "unknown").alias("rule_id"),
        either("rule_name", "Unknown Rule").alias("rule_name"),
        F.coalesce(f["adjusted_severity"], f["severity"], F.lit("unknown")).alias("severity"),
        F.coalesce(f["line_number"], F.lit(0)).cast("long").alias("line_number"),
        either("file_path", "").alias("file_path"),
        F.coalesce(f["severity_changed"], F.lit(False)).alias("severity_changed"),
        F.coalesce(f["in_code_block"], F.lit(False)).alias("in_code_block"),
    )


def runtime_approvals(requests: DataFrame, skills: DataFrame, revisions: DataFrame) -> DataFrame:
    """A request is approved if it names a current, approved revision by id and digest."""
    good = (
        current_revision(skills, revisions, "inner")
        .where((F.col("rev_skill_id") == F.col("skill_id")) & F.col("rev_is_current") & (F.col("rev_status") == "approved"))
        .select("canonical_skill_id", F.col("rev_artifact_digest").alias("artifact_digest"), F.col("rev_revision_id").alias("revision_id"))
        .where(F.col("canonical_skill_id").isNotNull() & F.col("artifact_digest").isNotNull())
    )
    one = good.groupBy("canonical_skill_id", "artifact_digest").agg(F.min("revision_id").alias("revision_id"))
    return requests.join(one, ["canonical_skill_id", "artifact_digest"], "left").withColumn("approved", F.col("revision_id").isNotNull())


def append_revisions(revisions: DataFrame, incoming: DataFrame, bucket: Column) -> DataFrame:
    """New revisions are numbered after the old ones, pending, without approval or digest.

    ``incoming`` has skill_id, seen_at, payload columns shared with ``revisions``. The
    last revision of a skill becomes its only current one.
    """
    last = revisions.groupBy("skill_id").agg(F.max("revision_number").alias("__last"))
    added = (
        numbered(incoming, ["skill_id"], ["seen_at", "revision_id"], bucket, "__step")
        .join(last, "skill_id", "left")
        .withColumn("revision_number", F.coalesce("__last", F.lit(0)) + F.col("__step"))
        .withColumn("status", F.lit("pending"))
        .withColumn("artifact_digest", F.lit(None).cast("string"))
        .withColumn("approved_by", F.lit(None).cast("string"))
        .drop("__last", "__step")
    )
    merged = revisions.drop("is_current").unionByName(added.select(*[c for c in revisions.columns if c != "is_current"]))
    newest = merged.groupBy("skill_id").agg(F.max("revision_number").alias("__newest"))
    return merged.join(newest, "skill_id").withColumn("is_current", F.col("revision_number") == F.col("__newest")).drop("__newest")


def lineage(revisions: DataFrame, bucket: Column) -> DataFrame:
    """Position of each revision, newest first."""
    return numbered(revisions, ["skill_id"], [F.desc("revision_number")], bucket, "position", descending=True)


def latest_per_skill(history: DataFrame, at: str, ident: str, n: int = 1) -> DataFrame:
    """The newest n scans or tests per skill."""
    return top_n(history, ["skill_id"], [F.desc(at), F.desc(ident)], n)


def recent_scans(scans: DataFrame, per_skill: int, total: int) -> DataFrame:
    """K5: a few scans per skill, then the newest of all."""
    return (
        latest_per_skill(scans, "scanned_at", "scan_id", per_skill)
        .orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(total)
    )


def rescan_deltas(scans: DataFrame, bucket: Column) -> DataFrame:
    """Each scan with the level and score of the scan before it."""
    return with_previous(scans, ["skill_id"], ["scanned_at", "scan_id"], bucket, ["risk_level", "risk_score"]).where(
        F.col("prev_risk_score").isNotNull()
    )


def rescan_improvement(scans: DataFrame) -> DataFrame:
    """What the latest scan of each skill changed against the one before."""
    pair = latest_per_skill(scans, "scanned_at", "scan_id", 2)
    per_skill = pair.groupBy("skill_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("risk_score"))).alias("new_score"),
        F.max(F.when(F.col("rank") == 2, F.col("risk_score"))).alias("old_score"),
        F.max(F.when(F.col("rank") == 1, F.col("risk_level"))).alias("new_level"),
        F.max(F.when(F.col("rank") == 2, F.col("risk_level"))).alias("old_level"),
    ).where(F.col("old_score").isNotNull())
    gain = F.col("old_score") - F.col("new_score")
    return per_skill.agg(
        F.count(F.lit(1)).alias("rescanned"),
        F.count_if(gain > 0).alias("risk_reduced"),
        F.coalesce(F.sum(F.when(gain > 0, gain)), F.lit(0)).cast("long").alias("total_score_reduction"),
        F.count_if(F.col("old_level") != F.col("new_level")).alias("level_changes"),
    )


def scan_distribution(results: DataFrame) -> DataFrame:
    """Scans per risk level with their share of all successful scans."""
    counts = results.where(F.col("succeeded")).groupBy("risk_level").agg(F.count(F.lit(1)).alias("scans"))
    total = F.sum("scans").over(Window.partitionBy(F.lit(1)))
    return counts.select("risk_level", "scans", F.round(F.col("scans") * 100.0 / total, 4).alias("percent"))


def corpus_statistics(documents: DataFrame, measures: list[str]) -> DataFrame:
    """A1: documents per category (blank is 'uncategorized') and sums, with a total row."""
    category = F.when(F.coalesce("category", F.lit("")) == "", "uncategorized").otherwise(F.col("category"))
    return (
        documents.withColumn("category", category)
        .rollup("category")
        .agg(F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in measures])
        .withColumn("category", F.coalesce("category", F.lit("<all>")))
        .orderBy(F.desc("documents"), "category")
    )


def governance_statistics(effective: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """A2: counts by status and by known risk level, and totals per table, as rows."""
    def tally(column: str, name: str) -> DataFrame:
        return (
            effective.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
            .agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "key", "value")
        )

    parts = [tally("status", "by_status"), tally("risk_level", "by_risk")]
    for name, df in {"skills": effective, **others}.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total").alias("metric"), F.lit(name).alias("key"), "value"))
    return reduce(DataFrame.unionByName, parts)


def overview(effective: DataFrame) -> DataFrame:
    """A3: dashboard counters in one pass."""
    status, risk = F.col("status"), F.col("risk_level")
    return effective.agg(
        F.count(F.lit(1)).alias("total_skills"),
        *[F.count_if(status == s).alias(f"{s}_count") for s in V.STATUSES],
        F.count_if(risk.isin("high", "critical")).alias("high_risk_count"),
        F.round(F.coalesce(F.avg("equivalence_score"), F.lit(0.0)), 2).alias("avg_fidelity_score"),
    )


def distribution(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """A4: counts for every value of a fixed domain, zero where there is none."""
    counts = df.agg(*[F.count_if(F.col(column) == value).alias(value) for value in domain])
    return counts.unpivot([], list(domain), "level", "rows")


def findings_by_rule(scans: DataFrame, last: int | None = None) -> DataFrame:
    """A5: findings per rule over all scans, or the ``last`` of each skill, first seen name and severity."""
    recent = scans if last is None else latest_per_skill(scans, "scanned_at", "scan_id", last)
    found = recent.select("scanned_at", "scan_id", F.posexplode(parsed_findings(F.col("findings_json"))).alias("pos", "f"))
    order = F.struct("scanned_at", "scan_id", "pos")
    rule = F.coalesce(F.col("f.rule_id"), F.lit("unknown"))
    return (
        found.withColumn("rule_id", rule)
        .groupBy("rule_id")
        .agg(
            F.min_by(F.coalesce(F.col("f.rule_name"), F.col("rule_id")), order).alias("rule_name"),
            F.min_by(F.coalesce(F.col("f.severity"), F.lit("unknown")), order).alias("severity"),
            F.count(F.lit(1)).alias("findings"),
        )
        .orderBy(F.desc("findings"), "rule_id")
    )


def job_summary(items: DataFrame) -> DataFrame:
    """Items per state, running workers and last times per job."""
    running = F.col("status") == "running"
    workers = items.where(running & (F.coalesce("claimed_by", F.lit("")) != "")).select("job_id", "claimed_by").distinct()
    active = workers.groupBy("job_id").agg(F.count(F.lit(1)).alias("active_workers"))
    summary = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in V.ITEM_STATUSES],
        F.max(F.when(running, F.col("lease_expires_at"))).alias("active_lease_expires_at"),
        F.max("started_at").alias("last_item_started_at"),
        F.max("completed_at").alias("last_item_completed_at"),
        F.min_by("error_code", F.when(F.col("status") == "failed", F.struct("created_at", "item_id"))).alias("first_error"),
    )
    return summary.join(active, "job_id", "left").fillna(0, ["active_workers"])


def job_final_state(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """State of a job once no item is open."""
    j = jobs.join(job_summary(items), "job_id", "left").fillna(0, list(V.ITEM_STATUSES))
    still_open = (F.col("queued") > 0) | (F.col("running") > 0) | (F.col("retrying") > 0)
    state = (
        F.when(still_open, F.col("job_status"))
        .when(F.col("job_status") == "cancelled", "cancelled")
        .when(F.col("failed") == 0, "completed")
        .when(F.col("succeeded") == 0, "failed")
        .otherwise("completed_with_failures")
    )
    error = F.when(
        ~still_open & (F.col("job_status") == "cancelled"), F.coalesce("job_error", F.lit("JOB_CANCELLED"))
    ).when(~still_open & (F.col("failed") > 0), F.col("first_error")).when(still_open, F.col("job_error"))
    return j.select("job_id", state.alias("final_status"), error.alias("error_code"))


def lease_expired(now: Column) -> Column:
    """No lease, or one that has ended."""
    return F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)


def retriable() -> Column:
    code = F.coalesce("error_code", F.lit(""))
    return (code != "") & ~code.isin(*V.NON_RETRIABLE)


def next_step() -> Column:
    """Advice for an item from its state and error."""
    status, code = F.col("status"), F.col("error_code")
    failed = status == "failed"
    return (
        F.when(status.isin("queued", "retrying"), "wait_for_worker")
        .when(status == "running", "monitor_lease_or_cancel")
        .when(status == "succeeded", "no_action")
        .when(status == "cancelled", "review_cancel_trace")
        .when(status == "skipped", "review_skip_reason")
        .when(failed & code.isin(*V.SOURCE_PATH_ERRORS), "fix_source_path")
        .when(failed & code.isin(*V.INSTALLED_PATH_ERRORS), "fix_installed_path")
        .when(failed & retriable(), "retry_item")
        .when(failed, "inspect_error")
        .otherwise("inspect_status")
    )


def risk_order() -> Column:
    """K3: blocked first, safe last, anything else after."""
    worst_first = list(reversed(V.RISK_LEVELS))
    order = F.when(F.col("risk_level") == worst_first[0], 1)
    for place, level in enumerate(worst_first[1:], start=2):
        order = order.when(F.col("risk_level") == level, place)
    return order.otherwise(len(worst_first) + 1)


def risk_report(effective: DataFrame) -> DataFrame:
    """K3: skills per risk level in report order."""
    return (
        effective.groupBy("risk_level").agg(F.count(F.lit(1)).alias("skills"), F.round(F.avg("risk_score"), 4).alias("avg_score"))
        .withColumn("place", risk_order().cast("long")).orderBy("place", "risk_level")
    )


def source_checksum() -> Column:
    """Digest of the provenance fields as JSON text with ', ' and ': ' separators."""
    def quoted(name: str) -> Column:
        text = F.to_json(F.struct(F.coalesce(name, F.lit("")).alias("v")))
        return F.concat(F.lit(f'"{name}": '), F.substring(text, F.lit(6), F.length(text) - 6))

    pieces = [quoted(name) for name in V.CHECKSUM_FIELDS]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}")), 256)


def duplicate_canonical_ids(skills: DataFrame) -> DataFrame:
    """Q5: canonical ids held by more than one skill."""
    return (
        skills.where(F.col("canonical_skill_id").isNotNull()).groupBy("canonical_skill_id")
        .agg(F.count(F.lit(1)).alias("skills")).where(F.col("skills") > 1)
    )


def approval_violations(skills: DataFrame, revisions: DataFrame) -> DataFrame:
    """Q6: approved revisions that could not have been approved."""
    approved = revisions.where(F.col("status") == "approved").select(
        "revision_id", "skill_id", "artifact_digest"
    )
    j = approved.join(
        skills.select("skill_id", "canonical_skill_id", "current_revision_id", F.col("status").alias("skill_status")), "skill_id"
    )
    checks = {
        "skill_blocked": F.col("skill_status") == "blocked",
        "not_current_revision": ~F.col("revision_id").eqNullSafe(F.col("current_revision_id")),
        "no_canonical_id": F.coalesce("canonical_skill_id", F.lit("")) == "",
        "no_artifact_digest": F.coalesce("artifact_digest", F.lit("")) == "",
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return j.select("revision_id", F.explode(found).alias("violation"))


def backfill(df: DataFrame, lookup: DataFrame, key: str, column: str, default: Column | None = None) -> DataFrame:
    """Fill a blank column from a (key, value) lookup, else from a default.

    A key may own any share of the rows.
    """
    one = lookup.groupBy(F.col("key").alias(key)).agg(F.min("value").alias("__value"))
    filled = F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("__value"), *([default] if default is not None else []))
    return spread_join(df, one, [key], "left").withColumn(column, filled).drop("__value")


def https_url(url: Column) -> Column:
    """git@host:path becomes https, and a .git ending goes."""
    trimmed = F.trim(url)
    web = F.regexp_replace(trimmed, r"^git@([^:]*):(.*)$", r"https://$1/$2")
    return F.regexp_replace(web, r"\.git$", "")


def provenance_matches(skills: DataFrame, originals: DataFrame, converted: DataFrame) -> DataFrame:
    """Skills with the files they came from and went to, and what is missing."""
    j = (
        skills.select("skill_id", "name")
        .join(originals.select("name", F.col("path").alias("original_path")), "name", "left")
        .join(converted.select("name", F.col("path").alias("converted_path")), "name", "left")
    )
    state = (
        F.when(F.col("original_path").isNull(), "missing_original")
        .when(F.col("converted_path").isNull(), "updated_without_conversion")
        .otherwise("updated")
    )
    return j.withColumn("result", state)


def provenance_revisions(matches: DataFrame, revisions: DataFrame) -> DataFrame:
    """The new pending revision of each matched skill."""
    last = revisions.groupBy("skill_id").agg(F.max("revision_number").alias("last"))
    return (
        matches.where(F.col("original_path").isNotNull()).join(last, "skill_id", "left")
        .select(
            "skill_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("revision_number"),
            F.lit("pending").alias("status"), F.col("original_path").alias("source_path"),
        )
    )

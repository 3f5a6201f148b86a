"""Asset identity, digests, index plans and drift between derived stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Identity formats of the asset contract.
ASSET_ID = "^[a-z0-9]+(?:_[a-z0-9]+)*__[a-z0-9]+(?:_[a-z0-9]+)*__[a-z0-9]+(?:_[a-z0-9]+)*$"
LEGACY, DERIVED = "legacy_exact", "source_name_disambiguation"
INDEX_IDENTITY = (
    "asset_id", "revision_id", "representation_version", "embedding_model_id", "embedding_model_version",
    "content_hash", "source_path",
)


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def canonical_digest(fields: dict[str, Column]) -> Column:
    """Digest of the compact JSON text with sorted keys; nulls are kept."""
    row = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return digest(F.to_json(row, {"ignoreNullFields": "false"}))


def derived_asset_id(legacy_id: Column, source_name: Column) -> Column:
    """Provider and scope of the legacy id with a slug of the source name; null if invalid."""
    parts = F.split(legacy_id, "__", 3)
    slug = F.regexp_replace(F.regexp_replace(F.lower(source_name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    candidate = F.concat_ws("__", F.get(parts, 0), F.get(parts, 1), slug)
    return F.when((F.size(parts) == 3) & candidate.rlike(ASSET_ID), candidate)


def resolve_identities(revisions: DataFrame) -> DataFrame:
    """Asset id and state of each revision (legacy_skill_id, source_name, source_path).

    A legacy id held once stays. One held by several is replaced by ids from the source
    names if all of those are valid and distinct; else its revisions are ambiguous. A derived
    id that is already taken is a collision.
    """
    legacy = F.col("legacy_skill_id")
    named = revisions.withColumn("derived_id", derived_asset_id(legacy, F.col("source_name")))
    groups = named.groupBy("legacy_skill_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("derived_id").isNull()).alias("invalid"),
    )
    distinct = named.where(F.col("derived_id").isNotNull()).groupBy("legacy_skill_id", "derived_id").agg(
        F.count(F.lit(1)).alias("same")).groupBy("legacy_skill_id").agg(F.max("same").alias("most"))
    state = groups.join(distinct, "legacy_skill_id", "left")
    single = F.col("n") == 1
    resolvable = (F.col("n") > 1) & (F.col("invalid") == 0) & (F.col("most") == 1)
    state = state.select("legacy_skill_id", single.alias("single"), F.coalesce(resolvable, F.lit(False)).alias("resolvable"))
    j = named.join(state, "legacy_skill_id")
    taken = groups.select(F.col("legacy_skill_id").alias("derived_id"), F.lit(True).alias("taken"))
    j = j.join(taken, "derived_id", "left")
    shared = j.where("resolvable").groupBy("derived_id").agg((F.countDistinct("legacy_skill_id") > 1).alias("shared"))
    j = j.join(shared, "derived_id", "left")
    collision = F.col("resolvable") & (F.coalesce("taken", F.lit(False)) | F.coalesce("shared", F.lit(False)))
    return j.select(
        *revisions.columns,
        F.when(F.col("resolvable"), F.col("derived_id")).otherwise(legacy).alias("asset_id"),
        F.when(F.col("resolvable"), DERIVED).otherwise(LEGACY).alias("identity_strategy"),
        F.when(F.col("single"), "available").when(collision, "collision").when(F.col("resolvable"), "available")
        .otherwise("ambiguous").alias("state"),
    )


def envelope_violations(envelopes: DataFrame) -> DataFrame:
    """What contradicts itself in an asset envelope, one row each."""
    c = F.col
    expected = F.when(c("identity_strategy") == LEGACY, c("skill_id")).when(
        c("identity_strategy") == DERIVED, derived_asset_id(c("skill_id"), c("source_name")))
    checks = {
        "unsupported_asset_type": c("asset_type") != "skill",
        "legacy_id_mismatch": ~c("legacy_skill_id").eqNullSafe(c("skill_id")),
        "unsupported_strategy": ~c("identity_strategy").isin(LEGACY, DERIVED),
        "asset_id_mismatch": c("identity_strategy").isin(LEGACY, DERIVED) & ~c("asset_id").eqNullSafe(expected),
        "content_hash_mismatch": ~c("content_hash").eqNullSafe(digest(c("payload"))),
        "revision_id_mismatch": ~c("revision_id").eqNullSafe(F.concat(F.lit("asset-revision:"), digest(c("payload")))),
        "provenance_skill_mismatch": ~c("provenance_skill_id").eqNullSafe(c("skill_id")),
        "source_path_missing": F.coalesce("source_path", F.lit("")) == "",
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(check, F.lit(True)), F.lit(n)) for n, check in checks.items()]))
    return envelopes.select("source_path", F.explode(found).alias("violation"))


def corpus_digest(revisions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One digest of a whole corpus, the same for any order of rows.

    Each row is digested; the digests are added up in four 60-bit parts, which partial sums
    do before the shuffle, so nothing is collected or sorted. Equal rows count each.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring("leaf", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = revisions.select(row.alias("leaf")).agg(
        F.count(F.lit(1)).alias("revisions"), *[F.sum(p).alias(f"part_{i}") for i, p in enumerate(parts)])
    text = F.concat_ws(":", F.col("revisions").cast("string"), *[F.col(f"part_{i}").cast("string") for i in range(4)])
    return sums.select(digest(text).alias("snapshot_id"), "revisions")


def asset_summaries(revisions: DataFrame) -> DataFrame:
    """Revisions per asset, ambiguity, first name and summary by source path."""
    return revisions.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("revision_count"), (F.count(F.lit(1)) > 1).alias("ambiguous"),
        F.min_by(F.coalesce("name", "asset_id"), "source_path").alias("name"),
        F.min_by(F.coalesce("summary", F.lit("")), "source_path").alias("summary"),
    )


def name_key(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))


def identity_drift(parsed: DataFrame, vector: DataFrame, governance: DataFrame) -> DataFrame:
    """Six kinds of drift between parsed documents, vector index and governance store."""
    def rows(df: DataFrame, kind: str, subject: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"))

    p_ids = parsed.select("skill_id").distinct()
    v_ids = vector.where(F.coalesce("skill_id", F.lit("")) != "").select("skill_id").distinct()
    no_revision = F.coalesce("current_revision_id", F.lit("")) == ""
    no_checksum = F.coalesce("source_checksum", F.lit("")) == ""
    names = parsed.select(name_key(F.col("name")).alias("__name")).distinct()
    sources = parsed.where(F.coalesce("source_path", F.lit("")) != "").select("source_path").distinct()
    unmatched = (
        governance.withColumn("__name", name_key(F.col("name"))).join(names, "__name", "left_anti").join(sources, "source_path", "left_anti")
    )
    parts = [
        rows(p_ids.join(v_ids, "skill_id", "left_anti"), "parsed_missing_from_vector", "skill_id"),
        rows(v_ids.join(p_ids, "skill_id", "left_anti"), "vector_missing_from_parsed", "skill_id"),
        rows(vector.where(F.coalesce("skill_id", F.lit("")) == ""), "vector_rows_without_skill_id", "row_id"),
        rows(governance.where(no_revision), "governance_missing_current_revision", "skill_id"),
        rows(governance.where(~no_revision & no_checksum), "governance_without_revision_checksum", "skill_id"),
        rows(unmatched, "governance_unmatched_to_parsed", "skill_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def index_drift(revisions: DataFrame, index_state: DataFrame) -> DataFrame:
    """Sources not indexed, indexed sources that are gone, and identities that differ."""
    same = ("asset_id", "revision_id", "content_hash")
    r = revisions.select("source_path", F.lit(True).alias("__r"), *[F.col(c).alias(f"r_{c}") for c in same])
    s = index_state.select("source_path", F.lit(True).alias("__s"), *[F.col(c).alias(f"s_{c}") for c in same])
    differs = reduce(lambda a, b: a | b, [~F.col(f"r_{c}").eqNullSafe(F.col(f"s_{c}")) for c in same])
    finding = (
        F.when(F.col("__s").isNull(), "pending_projection").when(F.col("__r").isNull(), "source_removed").when(differs, "identity_mismatch")
    )
    return r.join(s, "source_path", "full_outer").select("source_path", finding.alias("finding")).where(F.col("finding").isNotNull())


def model_drift(index_state: DataFrame) -> DataFrame:
    """Model pairs in the index, if there is more than one."""
    pairs = index_state.groupBy("embedding_model_id", "embedding_model_version").agg(F.count(F.lit(1)).alias("rows"))
    number = pairs.select(F.count(F.lit(1))).scalar()
    return pairs.where(number > 1)


def authority_findings(revisions: DataFrame, skills: DataFrame, governance_revisions: DataFrame) -> DataFrame:
    """Revisions without a current, approved and equal governance revision; first reason wins."""
    g = governance_revisions.select(
        F.col("revision_id").alias("current_revision_id"), F.col("skill_id"), F.lit(True).alias("__found"),
        F.col("artifact_digest"), F.col("status"), F.col("is_current"))
    bound = skills.where(F.col("canonical_skill_id").isNotNull()).select(
        F.col("canonical_skill_id").alias("asset_id"), "skill_id", "current_revision_id", F.lit(True).alias("__bound"))
    one = bound.join(g, ["skill_id", "current_revision_id"], "left")
    j = revisions.select("asset_id", "content_hash").join(one, "asset_id", "left")
    approved = (F.col("status") == "approved") & F.col("is_current")
    reason = (
        F.when(F.col("__bound").isNull(), "binding_missing")
        .when(F.col("__found").isNull(), "current_revision_missing")
        .when(~F.coalesce(approved, F.lit(False)), "revision_not_approved_current")
        .when(~F.col("artifact_digest").eqNullSafe(F.col("content_hash")), "artifact_digest_mismatch")
    )
    return j.select("asset_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def name_coverage(governance: DataFrame, parsed: DataFrame) -> DataFrame:
    """Names in both stores or in one, compared in lower case."""
    def names(df: DataFrame, flag: str) -> DataFrame:
        return df.select(F.lower("name").alias("name")).where(F.col("name") != "").distinct().withColumn(flag, F.lit(True))

    state = F.when(F.col("in_governance") & F.col("in_parsed"), "in_both").when(F.col("in_governance"), "governance_only").otherwise("parsed_only")
    return names(governance, "in_governance").join(names(parsed, "in_parsed"), "name", "full_outer").select("name", state.alias("coverage"))


def manifest_status(declared: DataFrame, applied: DataFrame) -> DataFrame:
    """Pending, applied or changed since."""
    a = applied.select("id", F.col("checksum").alias("__applied"), F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "pending").when(
        F.col("checksum").eqNullSafe(F.col("__applied")), "applied").otherwise("checksum_drift")
    return declared.join(a, "id", "left").select("id", state.alias("status"))


def store_health(findings: DataFrame) -> DataFrame:
    """One state from finding rows (kind), worst first."""
    def any_of(*kinds: str) -> Column:
        return F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False))

    state = (
        F.when(any_of("unknown", "migration_checksum_drift"), "unknown")
        .when(any_of("authority_missing", "duplicate_canonical_identity"), "authority-missing")
        .when(any_of("pending_projection", "stale_index_identity", "model_version_drift"), "stale-derived-projection")
        .otherwise("healthy")
    )
    return findings.agg(state.alias("state"), F.count(F.lit(1)).alias("findings"))


def index_plan(revisions: DataFrame, index_state: DataFrame) -> DataFrame:
    """V9: each source as unchanged, changed or removed by its identity; only changed ones need vectors."""
    known = index_state.select(*INDEX_IDENTITY).distinct().withColumn("__known", F.lit(True))
    condition = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in INDEX_IDENTITY])
    joined = revisions.alias("r").join(known.alias("s"), condition, "left")
    active = joined.select(F.col("r.source_path").alias("source_path"), F.when(F.col("__known"), "unchanged").otherwise("changed").alias("plan"))
    return active.unionByName(removed_sources(index_state, revisions).withColumn("plan", F.lit("removed")))


def removed_sources(index_state: DataFrame, revisions: DataFrame) -> DataFrame:
    """U4: indexed sources that are no longer active."""
    return index_state.select("source_path").distinct().join(revisions.select("source_path"), "source_path", "left_anti")


def index_report(plan: DataFrame) -> DataFrame:
    """V9: counts of the plan."""
    p = F.col("plan")
    return plan.agg(
        F.count_if(p != "removed").alias("total"), F.count_if(p == "changed").alias("changed"),
        F.count_if(p == "unchanged").alias("unchanged"), F.count_if(p == "removed").alias("removed"),
    )


def reconciled(snapshot: DataFrame, changed: DataFrame, active: DataFrame) -> DataFrame:
    """The snapshot without removed and changed sources, plus the changed ones."""
    kept = snapshot.join(active.select("source_path").distinct(), "source_path", "left_semi").join(
        changed.select("source_path"), "source_path", "left_anti")
    return kept.unionByName(changed)


def reindexed(snapshot: DataFrame, active: DataFrame, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The snapshot (index identity, embedding) after a run that embeds the changed sources only.

    ``texts`` has source_path and text; ``embed`` gives source_path and embedding of such rows. A changed source without a vector
    fails the run, so that no snapshot calls it indexed.
    """
    plan = index_plan(active, snapshot).where(F.col("plan") == "changed")
    changed = active.join(plan, "source_path", "left_semi").select(*INDEX_IDENTITY)
    vectors = embed(texts.join(changed.select("source_path"), "source_path", "left_semi"))
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col("source_path"))).cast(vectors.schema["embedding"].dataType)
    rows = changed.join(vectors.select("source_path", "embedding"), "source_path", "left")
    rows = rows.select(*INDEX_IDENTITY, F.coalesce("embedding", missing).alias("embedding"))
    return reconciled(snapshot.select(*rows.columns), rows, active)


def upserted(existing: DataFrame, batch: DataFrame, dimension: int) -> DataFrame:
    """Batch rows replace rows of the same file name; a wrong dimension fails the whole batch.

    ``batch`` has filename, title, name, description, skill_layer, schema_version, the three
    element arrays and an embedding.
    """
    def count(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)).cast("long")

    checked = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit(f"embedding must have {dimension} values, got "), F.size("embedding").cast("string"))))
    rows = batch.select(
        "filename", F.coalesce(F.nullif("title", F.lit("")), F.col("name"), F.lit("")).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("skill_layer", F.lit("")).alias("category"),
        F.coalesce("schema_version", F.lit("")).alias("version"), count("actions").alias("action_count"),
        count("rules").alias("rule_count"), count("directives").alias("directive_count"), checked.alias("embedding"),
    )
    return existing.join(rows.select("filename"), "filename", "left_anti").unionByName(rows)


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the surplus."""
    columns = left.columns
    both = left.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(
        right.select(*columns).withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1)))
    counts = both.groupBy(*columns).agg((F.sum("__l") - F.sum("__r")).alias("surplus")).where(F.col("surplus") != 0)
    return counts.withColumn("side", F.when(F.col("surplus") > 0, "missing").otherwise("extra")).withColumn("surplus", F.abs("surplus"))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values on one side only (both frames have one column of the same name)."""
    return left.subtract(right).withColumn("side", F.lit("left_only")).unionByName(
        right.subtract(left).withColumn("side", F.lit("right_only")))


def latest_snapshot_rows(history: DataFrame, key: str, version: str) -> DataFrame:
    """The rows a repository would return: the last version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return history.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")

"""Nested decomposition documents: normalisation, validation, references and text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import text_values as V
from skein.sources.snapshots import stored

#: Rows of distinct bindings per task, on average.
BINDINGS = 500_000


def filled(c: Column) -> Column:
    """Null for blank, as in 'not set'."""
    return F.nullif(c, F.lit(""))


def normalise_action(a: Column) -> Column:
    """Legacy fields (type, content) take their canonical place."""
    described = F.coalesce(filled(a["description"]), filled(a["content"]))
    fallback = F.concat(F.lit("Action "), F.coalesce(filled(F.upper(a["id"])), F.lit("Unnamed")))
    name = F.coalesce(filled(a["name"]), X.short_name(described, fallback))
    return F.struct(
        a["id"].alias("id"), name.alias("name"),
        F.coalesce(filled(a["description"]), filled(a["content"]), name).alias("description"),
        F.coalesce(filled(a["action_type"]), a["type"]).alias("action_type"),
        F.coalesce(a["deterministic"], F.lit(True)).alias("deterministic"),
        F.coalesce(a["side_effects"], F.array().cast("array<string>")).alias("side_effects"),
    )


def normalise_rule(r: Column) -> Column:
    """Condition, class and result of a legacy rule."""
    described, condition = filled(r["description"]), filled(r["condition"])
    fallback = F.concat(F.lit("Rule "), F.coalesce(filled(F.upper(r["id"])), F.lit("Unnamed")))
    name = F.coalesce(filled(r["name"]), X.short_name(F.coalesce(described, condition), fallback))
    return F.struct(
        r["id"].alias("id"), name.alias("name"),
        F.coalesce(filled(r["condition_type"]), X.condition_type(described, condition, name)).alias("condition_type"),
        F.coalesce(filled(r["condition_expression"]), condition, described, name).alias("condition_expression"),
        F.coalesce(filled(r["returns"]), X.returns_type(r["output"])).alias("returns"),
        r["description"].alias("description"),
        X.fail_action(r["fail_action"]).alias("fail_action"),
    )


def normalise_directive(d: Column) -> Column:
    """T14."""
    described = F.coalesce(filled(d["description"]), filled(d["content"]), d["name"])
    fallback = F.concat(F.lit("Directive "), F.coalesce(filled(F.upper(d["id"])), F.lit("Unnamed")))
    return F.struct(
        d["id"].alias("id"),
        F.coalesce(filled(d["name"]), X.short_name(described, fallback)).alias("name"),
        F.coalesce(filled(d["directive_type"]), d["type"]).alias("directive_type"),
        described.alias("description"),
    )


def normalise_path(p: Column, index: Column) -> Column:
    """Id, condition and outcome of an execution path."""
    return F.struct(
        F.coalesce(p["path_id"], (index + 1).cast("int")).alias("path_id"),
        p["path_name"].alias("path_name"), p["sequence"].alias("sequence"),
        F.coalesce(filled(p["condition"]), filled(p["path_name"]), filled(p["description"]), F.lit("default")).alias("condition"),
        F.coalesce(filled(p["expected_outcome"]), p["description"]).alias("expected_outcome"),
    )


def normalise_documents(documents: DataFrame) -> DataFrame:
    """All parts of legacy documents; ``changed`` tells whether anything moved.

    Columns: doc_id, skill_id, skill_layer, name, schema_version, actions, rules, directives
    and, if there are any, execution_paths.
    """
    before = F.struct(*[F.col(c) for c in documents.columns])
    out = documents.withColumn("__before", before).withColumn("skill_id", X.skill_id(F.col("skill_id"), F.col("skill_layer"), F.col("name")))
    out = out.withColumn("schema_version", F.lit(V.SCHEMA_VERSION))
    parts = {"actions": normalise_action, "rules": normalise_rule, "directives": normalise_directive}
    for column, normal in parts.items():
        out = out.withColumn(column, F.transform(F.col(column), normal))
    if "execution_paths" in documents.columns:
        out = out.withColumn("execution_paths", F.transform("execution_paths", normalise_path))
    after = F.struct(*[F.col(c) for c in documents.columns])
    return out.withColumn("changed", F.to_json("__before") != F.to_json(after)).drop("__before")


def invalid_elements(elements: DataFrame) -> DataFrame:
    """Element errors. Columns doc_id, kind, id, name, element_type, description and,
    for rules, condition_expression and returns; null is a missing field."""
    kind = F.col("kind")
    domains = {"action": V.ACTION_TYPES, "rule": V.CONDITION_TYPES, "directive": V.DIRECTIVE_TYPES}
    required = {
        "action": ("id", "name", "element_type", "description", "deterministic"),
        "rule": ("id", "name", "element_type", "condition_expression", "returns"),
        "directive": ("id", "name", "element_type", "description"),
    }
    problems = []
    for k, values in domains.items():
        here = kind == k
        problems.append(F.when(here & ~F.coalesce(F.col("id"), F.lit("")).rlike(rf"^{k[0]}_\d{{3}}$"), F.lit("invalid_id")))
        problems.append(F.when(here & ~F.coalesce(F.col("element_type").isin(*values), F.lit(False)), F.lit("invalid_type")))
        for field in required[k]:
            if field in elements.columns:
                problems.append(F.when(here & F.col(field).isNull(), F.lit(f"missing_{field}")))
    return elements.select("doc_id", "kind", "id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def invalid_meta(meta: DataFrame) -> DataFrame:
    """Document-level errors, and a warning for an old schema version."""
    required = ("skill_id", "name", "skill_layer", "title", "description", "schema_version")
    problems = [F.when(F.col(f).isNull(), F.struct(F.lit("error").alias("level"), F.lit(f"missing_{f}").alias("problem"))) for f in required]
    problems.append(F.when(~F.coalesce(F.col("skill_layer").isin(*V.LAYERS), F.lit(False)),
                           F.struct(F.lit("error").alias("level"), F.lit("invalid_skill_layer").alias("problem"))))
    problems.append(F.when(~F.col("schema_version").eqNullSafe(F.lit(V.SCHEMA_VERSION)),
                           F.struct(F.lit("warning").alias("level"), F.lit("outdated_schema_version").alias("problem"))))
    return meta.select("doc_id", F.explode(F.array_compact(F.array(*problems))).alias("p")).select("doc_id", "p.*")


def unknown_references(references: DataFrame, elements: DataFrame) -> DataFrame:
    """References (doc_id, source, ref_id) to elements the document does not have."""
    known = elements.select("doc_id", F.col("element_id").alias("ref_id")).distinct()
    return references.join(known, ["doc_id", "ref_id"], "left_anti").select("doc_id", "source", "ref_id").distinct()


def binding_problems(bindings: DataFrame) -> DataFrame:
    """Contract problems of action bindings (doc_id, action_id, role, compensation_id).

    Equal bindings are counted first and stored, so the input is read once; what follows moves a row per action and per named compensation,
    in as many tasks as there are ``BINDINGS`` rows, whatever they are compressed to.
    """
    key = ["doc_id", "action_id"]
    compensates = F.col("role") == "compensation"
    named = F.when(F.coalesce("compensation_id", F.lit("")) != "", F.col("compensation_id"))
    one = stored(bindings.groupBy(*key, named.alias("target")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(compensates).alias("is_compensation"),
        F.bool_or(~F.coalesce(F.col("role").isin("primary", "compensation"), F.lit(False))).alias("other_role")), "bindings")
    tasks = max(1, -(-one.count() // BINDINGS))
    by_action = one.repartition(tasks, *key)
    actions = by_action.groupBy(*key).agg(
        F.sum("n").alias("n"), F.bool_or("is_compensation").alias("is_compensation"), F.bool_or("other_role").alias("other_role"),
        F.bool_or(F.col("target") == F.col("action_id")).alias("to_itself"))
    problems = F.array(
        F.when(F.col("n") > 1, F.lit("duplicate_binding")), F.when(F.col("other_role"), F.lit("invalid_role")), F.when(F.col("to_itself"), F.lit("compensates_itself")))
    own = actions.select(*key, F.explode(F.array_compact(problems)).alias("problem"))

    named = one.where(F.col("target").isNotNull()).select(*key, "target").repartition(tasks, "doc_id", "target")
    targets = by_action.groupBy(*key).agg(F.bool_or("is_compensation").alias("is_compensation")).withColumnRenamed("action_id", "target")
    state = F.when(F.col("is_compensation").isNull(), "target_has_no_binding").when(~F.col("is_compensation"), "target_role_is_not_compensation")
    target = named.join(targets, ["doc_id", "target"], "left").select(*key, state.alias("problem")).where(F.col("problem").isNotNull())
    target = target.repartition(tasks, *key).distinct()
    used = named.select("doc_id", F.col("target").alias("action_id")).distinct()
    orphan = by_action.where("is_compensation").select(*key).distinct().join(used, key, "left_anti").select(*key, F.lit("orphan_compensation").alias("problem"))
    return own.unionByName(target).unionByName(orphan)


def manifest_overlap(manifest: DataFrame) -> DataFrame:
    """Directives both included and excluded (doc_id, include, exclude arrays)."""
    return manifest.select("doc_id", F.explode(F.array_intersect("include", "exclude")).alias("directive_id"))


def document_text(title: Column, name: Column, description: Column, actions: Column, rules: Column, directives: Column, length: int | None = None) -> Column:
    """Text form of a document for search and embedding; ``length`` may bound the content of a directive."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Skill: "), title)).when(
        F.coalesce(name, F.lit("")) != "", F.concat(F.lit("Skill: "), name))
    about = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("Description: "), description))

    def part(label: str, items: Column, line) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.transform(items, line), "; ")))

    def action(a: Column) -> Column:
        title_ = F.coalesce(a["name"], a["description"], a["id"], F.lit(""))
        return F.concat(F.coalesce(a["action_type"], F.lit("unknown")), F.lit(": "), title_, F.lit(" - "), F.coalesce(a["description"], title_))

    def rule(r: Column) -> Column:
        title_ = F.coalesce(r["name"], r["description"], r["id"], F.lit(""))
        return F.concat(F.coalesce(r["condition_type"], F.lit("unknown")), F.lit(": "), title_, F.lit(" - "),
                        F.coalesce(r["condition_expression"], title_))

    def directive(d: Column) -> Column:
        title_ = F.coalesce(d["name"], d["description"], d["id"], F.lit(""))
        content = F.coalesce(d["description"], title_)
        if length is not None:
            content = F.when(F.length(content) > length, F.concat(F.substring(content, 1, length), F.lit("..."))).otherwise(content)
        return F.concat(F.coalesce(d["directive_type"], F.lit("unknown")), F.lit(": "), title_, F.lit(" - "), content)

    return F.concat_ws(" | ", head, about, part("Actions", actions, action), part("Rules", rules, rule),
                       part("Directives", directives, directive))


def migrate_versions(documents: DataFrame, columns: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """Old to new version per column; (old, new, prefix) where prefix also renews 'old...' once."""
    changed = F.lit(False)
    new_columns = {}
    for name, (old, new, prefix) in columns.items():
        c = F.col(name)
        hit = F.coalesce(c.startswith(old) if prefix else c == old, F.lit(False))
        renewed = F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))
        new_columns[name] = F.when(hit, renewed).otherwise(c)
        changed = changed | hit
    return documents.withColumn("changed", changed).withColumns(new_columns)


def build_documents(records: DataFrame, length: int | None = None) -> DataFrame:
    """Document rows from record rows (skill_id, name, description, source); ``length`` may bound the description."""
    described = F.col("description")
    return records.select(
        F.struct(
            F.concat(F.lit("claude__skill__"), F.col("skill_id")).alias("skill_id"), "name",
            F.lit("claude_skill").alias("skill_layer"), F.concat(F.initcap("name"), F.lit(" Skill")).alias("title"),
            (described if length is None else F.substring(described, 1, length)).alias("description"), F.lit(V.SCHEMA_VERSION).alias("schema_version"),
        ).alias("meta"),
        F.struct(
            F.col("source").alias("source"), F.col("name").alias("skill_name"), described.alias("skill_description")
        ).alias("original_definition"),
    )

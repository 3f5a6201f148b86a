"""Corpus statistics and pattern mining over typed elements.

Element columns: doc_id, kind (action, rule, directive), element_id, element_type,
description. Summaries carry counts; members of a pattern are rows of their own, since
a list of members grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text_values as V
from skein.operators.skew import top_n


def document_counts(elements: DataFrame) -> DataFrame:
    """A10: elements per document and kind."""
    kind, n = F.col("kind"), F.col("n")
    typed = elements.groupBy("doc_id", "kind", "element_type").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("element_type").isNotNull()
    return typed.groupBy("doc_id").agg(
        *[F.sum(F.when(kind == k, n).otherwise(0)).alias(f"{k}s") for k in ("action", "rule", "directive")],
        F.count_if((kind == "action") & known).alias("action_types"),
        F.count_if((kind == "directive") & known).alias("directive_types"),
    )


def type_distribution(elements: DataFrame) -> DataFrame:
    """A10: elements per kind and type, with kind totals."""
    typed = elements.withColumn("element_type", F.coalesce("element_type", F.lit("unknown")))
    return typed.groupingSets([["kind"], ["kind", "element_type"]], "kind", "element_type").agg(
        F.count(F.lit(1)).alias("elements")
    ).withColumn("element_type", F.coalesce("element_type", F.lit("<all>")))


def type_coverage(elements: DataFrame, kind: str, expected: Sequence[str]) -> DataFrame:
    """Expected types found or missing, found ones that nobody expected, and the rate."""
    found = elements.where(F.col("kind") == kind).select(F.coalesce("element_type", F.lit("unknown")).alias("type")).distinct()
    flags = found.agg(*[F.bool_or(F.col("type") == t).alias(t) for t in expected]).fillna(False)
    hits = sum((F.col(t).cast("int") for t in expected), F.lit(0))
    state = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("found")) for t in expected])
    known = flags.select(F.round(hits / len(expected), 6).alias("coverage_rate"), F.explode(state).alias("s")).select(
        "s.type", F.lit(True).alias("expected"), "s.found", "coverage_rate"
    )
    extra = found.where(~F.col("type").isin(*expected)).select(
        "type", F.lit(False).alias("expected"), F.lit(True).alias("found"), F.lit(None).cast("double").alias("coverage_rate")
    )
    return known.unionByName(extra)


def category_averages(counts: DataFrame, categories: DataFrame) -> DataFrame:
    """Mean elements per document of each listed category, one place."""
    return counts.join(categories, "doc_id").groupBy("category").agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.round(F.avg(c), 1).alias(f"avg_{c}") for c in ("actions", "rules", "directives")],
    )


def type_sets(elements: DataFrame, kind: str = "action") -> DataFrame:
    """Distinct types per document; the type domain bounds each set."""
    typed = elements.where(F.col("kind") == kind).select("doc_id", F.coalesce("element_type", F.lit("unknown")).alias("type"))
    return typed.groupBy("doc_id").agg(F.sort_array(F.collect_set("type")).alias("types"))


def cooccurrence(elements: DataFrame, top: int = 10, least: int = 2) -> DataFrame:
    """Type pairs by the documents that hold both; the top is cut before the minimum.

    Documents with the same set of types count as one weighted row, so pairs are formed
    once per set, not once per document.
    """
    sets = type_sets(elements).groupBy("types").agg(F.count(F.lit(1)).alias("docs"))
    total = sets.agg(F.sum("docs")).scalar()
    pairs = F.flatten(F.transform(
        "types", lambda a, i: F.transform(F.filter("types", lambda b: b > a), lambda b: F.struct(a.alias("a1"), b.alias("a2")))
    ))
    best = (
        sets.select("docs", F.explode(pairs).alias("p")).groupBy("p.a1", "p.a2").agg(F.sum("docs").alias("docs"))
        .orderBy(F.desc("docs"), "a1", "a2").limit(top).where(F.col("docs") >= least)
    )
    return best.select(
        F.concat_ws("_", F.lit("pat_act"), "a1", "a2").alias("pattern_id"), "a1", "a2", "docs",
        F.round(F.col("docs") / total, 6).alias("frequency"),
    )


def cooccurrence_members(elements: DataFrame, patterns: DataFrame) -> DataFrame:
    """Documents of each pair pattern, as rows. ``patterns`` are the few of ``cooccurrence``."""
    first = type_sets(elements).select("doc_id", "types", F.explode("types").alias("a1"))
    return first.join(F.broadcast(patterns.select("pattern_id", "a1", "a2")), "a1").where(
        F.array_contains("types", F.col("a2"))
    ).select("pattern_id", "doc_id")


def directive_usage(elements: DataFrame, documents: int | Column, examples: int = 3, length: int | None = None) -> DataFrame:
    """Items per directive type against all documents, documents that hold it, first examples, whole unless a length is given."""
    example = F.coalesce("description", F.lit(""))
    d = elements.where(F.col("kind") == "directive").select(
        "doc_id", "element_id", F.coalesce("element_type", F.lit("unknown")).alias("directive_type"),
        (example if length is None else F.substring(example, 1, length)).alias("example"),
    )
    usage = d.groupBy("directive_type").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("doc_id").alias("documents")
    )
    few = top_n(d, ["directive_type"], ["doc_id", "element_id"], examples).groupBy("directive_type").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "example"))), lambda e: e["example"]), " | ").alias("examples")
    )
    return usage.join(few, "directive_type").withColumn("frequency", F.round(F.col("items") / F.lit(documents), 6))


def structure_classes(elements: DataFrame) -> DataFrame:
    """Each document under every structure class that fits."""
    c = document_counts(elements).select("doc_id", "actions", "rules", "directives")
    total = F.col("actions") + F.col("rules") + F.col("directives")
    action, rule = F.col("actions") / total, F.col("rules") / total
    flags = F.array_compact(F.array(
        F.when(action > 0.6, "action_heavy"),
        F.when(rule > 0.4, "rule_heavy"),
        F.when(action.between(0.2, 0.5) & rule.between(0.2, 0.5), "balanced"),
    ))
    return c.where(total > 0).select("doc_id", F.explode_outer(flags).alias("structure"))


def structure_patterns(elements: DataFrame) -> DataFrame:
    """Share of documents per structure class."""
    members = structure_classes(elements)
    counts = members.agg(
        F.countDistinct("doc_id").alias("total"),
        *[F.count_if(F.col("structure") == s).alias(s) for s in ("action_heavy", "rule_heavy", "balanced")],
    )
    rows = counts.unpivot(["total"], ["action_heavy", "rule_heavy", "balanced"], "structure", "documents")
    return rows.where(F.col("documents") > 0).select(
        "structure", "documents", F.round(F.col("documents") / F.col("total"), 6).alias("frequency")
    )


def keyword_patterns(elements: DataFrame, documents: int | Column) -> DataFrame:
    """Documents with a keyword of a category in any description."""
    text = F.lower(F.coalesce("description", F.lit("")))
    hits = {
        name: F.bool_or(text.rlike("|".join(w.lower() for w in words))).alias(name) for name, words in V.KEYWORD_PATTERNS
    }
    per_doc = elements.groupBy("doc_id").agg(*hits.values())
    counts = per_doc.agg(*[F.count_if(F.col(name)).alias(name) for name in hits])
    return counts.unpivot([], list(hits), "category", "documents").where(F.col("documents") > 0).withColumn(
        "frequency", F.round(F.col("documents") / F.lit(documents), 6)
    )


def common_sequences(sequences: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent 'a->b->c' strings that occur more than once; ``sequence`` is an array."""
    text = F.array_join("sequence", "->")
    return (
        sequences.where(F.size("sequence") > 0).groupBy(text.alias("pattern")).agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "pattern").limit(top).where(F.col("occurrences") > 1)
    )


def complexity(elements: DataFrame) -> DataFrame:
    """Share of each kind and the complexity class of a document."""
    c = document_counts(elements).drop("action_types", "directive_types")
    total = F.col("actions") + F.col("rules") + F.col("directives")
    level = F.when(F.col("total") < 8, "Simple").when(F.col("total") < 15, "Medium").otherwise("Complex")
    return c.withColumn("total", total).withColumns(
        {f"{k}_share": F.round(F.col(f"{k}s") / F.col("total") * 100, 1) for k in ("action", "rule", "directive")}
    ).withColumn("complexity", level)


def format_inventory(paths: DataFrame) -> DataFrame:
    """Files per source format by name."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = F.when(name == "skill.md", "skill.md").when(name.endswith(".instructions.md"), "instructions.md").otherwise("unknown")
    return paths.groupBy(kind.alias("format")).agg(F.count(F.lit(1)).alias("files"))


def ingest_funnel(steps: DataFrame) -> DataFrame:
    """Outcome of each batch. Columns: batch, has_file, registered, imported, approved."""
    skipped = ~F.col("has_file")
    done = F.col("has_file") & (F.col("registered") | F.col("imported"))
    return steps.groupBy("batch").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("succeeded"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(~skipped & ~done).alias("failed"),
        F.count_if(done & F.col("approved")).alias("approved"),
    )

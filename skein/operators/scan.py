"""Rule-pack scanning of lines, context-aware severity and risk scores."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import scan_values as V
from skein.functions.scan_values import Rule
from skein.functions.text import computed_once
from skein.session import work_folder


# Letters that match an ASCII letter without regard to case but do not lower to it.
FOLDING = "\u0130\u0131\u017f\u212a"
FOLDED = "iisk"


# Escapes of two signs that stand for a kind of character or a place.
SIMPLE_ESCAPES = set("sSdDwWbBAzZGtnrfvhHRea")


def _class_end(pattern: str, start: int) -> int:
    """Place after a character class, or -1 if it is not certain."""
    i, depth = start + 1, 1
    if pattern[i : i + 1] == "]" or pattern[i : i + 2] == "^]":
        return -1
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
            if pattern[i : i + 1] == "Q":
                return -1
        elif pattern[i] == "[":
            depth += 1
        elif pattern[i] == "]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def required_texts(pattern: str) -> list[str]:
    """Plain texts, lower case, that every match of a pattern must hold.

    Reads only what is plain for certain: escaped signs, letters, digits, '-', '_' and such
    outside of groups and classes that nothing after them makes optional. Where an escape or a
    flag could change the meaning of what follows, nothing is known.
    """
    if re.search(r"\(\?[a-zA-Z-]*x", pattern):
        return []
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        c, size, plain = pattern[i], 1, None
        if c == "\\":
            size = 2
            sign = pattern[i + 1 : i + 2]
            if sign.isalnum() and sign not in SIMPLE_ESCAPES:
                return []
            if not sign.isalnum():
                plain = sign
        elif c == "[":
            end = _class_end(pattern, i)
            if end < 0:
                return []
            size = end - i
        elif c == "{":
            end = pattern.find("}", i)
            if end < 0:
                return []
            size = end - i + 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return []
        elif c not in ".^$|?*+}":
            plain = c
        after = pattern[i + size : i + size + 1]
        if plain is not None and plain.isascii() and depth == 0 and after not in ("?", "*", "{"):
            run += plain.lower()
            if after == "+":
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
        i += size
    return sorted({r for r in [*runs, run] if r}, key=lambda r: (-len(r), r))


def key_of(pattern: str) -> str:
    """The longest required text of a pattern, '' if it has none."""
    return next(iter(required_texts(pattern)), "")


def any_word(words: set[str]) -> str:
    """Regular expression for the longest of some words at a place, sharing their beginnings."""
    starts = sorted({w[0] for w in words if w})
    branches = [re.escape(c) + any_word({w[1:] for w in words if w and w[0] == c}) for c in starts]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and "" not in words else f"(?:{'|'.join(branches)})"
    return f"{body}?" if "" in words else body


def searchable(df: DataFrame, text: str) -> DataFrame:
    """Adds the text in lower case, where ``possible`` looks for required texts."""
    folding = reduce(lambda a, b: a | b, [F.col(text).contains(c) for c in FOLDING])
    return computed_once(df, __low=F.lower(text), __folding=folding)


def with_keys(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Adds the pattern keys that occur in a ``searchable`` text.

    One pass finds the keys of all patterns, however many there are. At a place where several
    keys start it gives the longest, of which the others are beginnings.
    """
    words = {key_of(p) for p in patterns} - {""}
    keys = F.regexp_extract_all("__low", F.lit(f"(?=({any_word(words)}))"), 1) if words else F.array().cast("array<string>")
    return computed_once(df, __keys=F.array_distinct(keys))


def sql_text(value: str) -> str:
    """A string constant of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def named(patterns: Sequence[str]) -> list[str]:
    """For each pattern, in SQL: its key is among ``__keys``, or it has none."""

    def here(key: str) -> str:
        return f"(__folding OR exists(__keys, k -> startswith(k, {sql_text(key)})))" if key else "true"

    return [here(key_of(p)) for p in patterns]


@lru_cache(maxsize=64)
def _matching_sql(text: str, patterns: tuple[str, ...], values: tuple[str, ...], wanted: tuple[str, ...]) -> str:
    tests = []
    for pattern, value, want in zip(patterns, values, wanted):
        texts = " AND ".join(f"contains(__low, {sql_text(x)})" for x in required_texts(pattern))
        possible = f"(__folding OR ({texts}))" if texts else "true"
        tests.append(f"CASE WHEN {want} AND {possible} AND {text} RLIKE {sql_text('(?iu)' + pattern)} THEN {value} END")
    return f"array_compact(array({', '.join(tests)}))"


def matching(text: str, patterns: Sequence[str], values: Sequence[str], wanted: Sequence[str]) -> Column:
    """Values (SQL) of the patterns that occur in a ``searchable`` text, as an array.

    Each pattern is a constant of the plan, compiled once, and only tried where it is wanted and its texts are. The whole expression is one
    piece of SQL, parsed at once: hundreds of patterns as single columns take longer to build than to run.
    """
    return F.expr(_matching_sql(text, tuple(patterns), tuple(values), tuple(wanted)))


CANDIDATES = "__candidates"


def _rows(rules: Sequence[Rule]) -> list[tuple[Rule, int, str]]:
    return [(r, i, p) for r in rules for i, p in enumerate(r.patterns)]


def with_candidates(documents: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Documents with the numbers of the patterns that can match in them at all.

    Lines taken from such documents are searched for these patterns only, and documents
    without any are left out of ``scan_lines`` before they are cut into lines.
    """
    patterns = [p for _, _, p in _rows(rules)]
    ready = with_keys(searchable(documents, text), patterns)
    places = F.expr(f"array_compact(array({', '.join(f'CASE WHEN {can} THEN {n} END' for n, can in enumerate(named(patterns)))}))")
    return computed_once(ready, **{CANDIDATES: places}).select(*documents.columns, CANDIDATES)


def scan_lines(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per line and pattern that matches anywhere in it."""
    rows = _rows(rules)
    keep = [c for c in lines.columns if c != CANDIDATES]
    if CANDIDATES in lines.columns:
        lines = lines.where(F.size(CANDIDATES) > 0)
        wanted = [f"array_contains({CANDIDATES}, {n})" for n in range(len(rows))]
    else:
        wanted = ["true"] * len(rows)
    values = [
        f"named_struct('rule_id', {sql_text(r.rule_id)}, 'rule_name', {sql_text(r.name)}, 'severity', {sql_text(r.severity)}, "
        f"'pattern_idx', CAST({i} AS BIGINT), 'pattern', {sql_text(p)})"
        for r, i, p in rows
    ]
    found = searchable(lines, "line").select(*keep, F.explode(matching("line", [p for *_, p in rows], values, wanted)).alias("hit"))
    return found.select(*keep, "hit.*")


#: Length of the grams that lead from a line to the patterns of a pack, most patterns without one that are constants of the plan, and places of the filter before the join.
GRAM = 3
FREE = 64
PLACES = 1 << 16


def _grams(text: Column) -> Column:
    """Distinct runs of GRAM characters."""
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PLACES)).cast("int")


def pack_index(rules: DataFrame) -> DataFrame:
    """Each pattern of a pack (rule_id, rule_name, severity, pattern_idx, pattern) with ``key``, the longest text that all its
    matches hold, and ``gram``, the run of that text which the fewest patterns share; '' for patterns whose text is shorter or unknown.
    """

    @F.pandas_udf("string")
    def keys(patterns: pd.Series) -> pd.Series:
        return patterns.map(key_of)

    keyed = rules.select("rule_id", "rule_name", "severity", F.col("pattern_idx").cast("long").alias("pattern_idx"), "pattern").withColumn("key", keys("pattern"))
    texts = keyed.select("key").distinct().withColumn("gram", F.explode_outer(_grams(F.col("key"))))
    shared = texts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = texts.join(shared, "gram", "left").groupBy("key").agg(F.min(F.struct("n", "gram")).alias("least"))
    return keyed.join(best, "key").withColumn("gram", F.coalesce("least.gram", F.lit(""))).drop("least")


def scan_pack(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per line and pattern of a pack of any size that matches anywhere in it; the pack stays a table.

    Patterns without a required text of GRAM characters must meet every line. Up to FREE of them are constants of the plan, tried where a line lies, without a
    copy of it; lines are read once for these and once for the others. More than FREE stay in the table.
    A line's grams meet the other patterns' by an equi-join, after a filter of PLACES marks (a constant, whatever the pack) has left out nearly all that no pattern
    has. Only pairs whose whole required text is in the line meet the regular expression, sorted by pattern, so that each is compiled once in a row.
    """
    index = computed_table(pack_index(rules))
    free = index.where("gram = ''").limit(FREE + 1).collect()
    if not free or len(free) > FREE:
        return _by_grams(lines, index)
    values = [
        f"named_struct('rule_id', {_constant(r['rule_id'])}, 'rule_name', {_constant(r['rule_name'])}, 'severity', {_constant(r['severity'])}, "
        f"'pattern_idx', CAST({'NULL' if r['pattern_idx'] is None else r['pattern_idx']} AS BIGINT), 'pattern', {sql_text(r['pattern'])})"
        for r in free
    ]
    found = searchable(lines, "line").select(*lines.columns, F.explode(matching("line", [r["pattern"] for r in free], values, ["true"] * len(free))).alias("hit"))
    found = found.select(*lines.columns, "hit.*")
    others = index.where("gram <> ''")
    return found if others.isEmpty() else found.unionByName(_by_grams(lines, others))


def _constant(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else sql_text(value)


def _by_grams(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Lines and patterns of a ``pack_index`` that share a gram, and match."""
    marks = {r["place"] for r in index.select(_place(F.col("gram")).alias("place")).distinct().collect()}
    bits = F.expr(f"split('{','.join('1' if i in marks else '0' for i in range(PLACES))}', ',')")
    low = F.lower(F.translate("line", FOLDING, FOLDED))
    ready = computed_once(lines, __text=low)
    found = F.filter(F.concat(F.array(F.lit("")), _grams(F.col("__text"))), lambda g: F.get(bits, _place(g)) == "1")
    pairs = ready.withColumn("gram", F.explode(found)).join(index, "gram").where(F.contains("__text", "key"))
    hits = pairs.sortWithinPartitions("pattern").where(F.rlike("line", F.concat(F.lit("(?iu)"), F.col("pattern"))))
    return hits.select(*lines.columns, "rule_id", "rule_name", "severity", "pattern_idx", "pattern")


def computed_table(df: DataFrame) -> DataFrame:
    """The frame written to the shared work folder and read again: worked out once, its size known to the planner."""
    folder = work_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def match_details(findings: DataFrame) -> DataFrame:
    """Matched text and its 0-based place; findings are few, so patterns may vary by row."""
    pattern = F.concat(F.lit("(?iu)"), F.col("pattern"))
    return findings.withColumn("match_text", F.regexp_substr("line", pattern)).withColumn(
        "match_pos", (F.regexp_instr("line", pattern) - 1).cast("long")
    )


def context_type() -> Column:
    """Where a line stands."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    return (
        F.when(F.col("in_code"), "code_block").when(text.startswith("#"), "heading").when(text.startswith(">"), "blockquote")
        .when(text.rlike(r"^([-*+]|\d+\.)"), "list_item").otherwise("prose")
    )


def severity_in_code(severity: Column) -> Column:
    """Severity of a match inside code."""
    out = F
    for was, now in V.SEVERITY_IN_CODE.items():
        out = out.when(severity == was, now)
    return out.otherwise("info")


def contextual_findings(lines: DataFrame, rules: Sequence[Rule] = V.CONTEXT_RULES) -> DataFrame:
    """Findings with the place of the line and the severity adjusted for code.

    ``lines`` come from ``lines_with_context``.
    """
    found = scan_lines(lines, rules).withColumnRenamed("severity", "original_severity")
    adjusted = F.when(F.col("in_code"), severity_in_code(F.col("original_severity"))).otherwise(F.col("original_severity"))
    language = F.coalesce(F.nullif(F.col("code_language"), F.lit("")), F.lit("unknown"))
    reason = F.when(
        F.col("in_code"),
        F.concat(F.lit("Pattern found inside code block ("), language, F.lit(" code example). Severity reduced from "),
                 F.col("original_severity"), F.lit(" to "), F.col("adjusted_severity"), F.lit(".")),
    ).otherwise("Pattern found in prose text - full severity applied.")
    return (
        found.withColumn("context_type", context_type()).withColumn("adjusted_severity", adjusted)
        .withColumn("adjustment_reason", reason)
    )


def code_spans(lines: DataFrame, key: str) -> DataFrame:
    """Code blocks per document with first and last line and language."""
    opened = F.col("is_fence") & F.col("in_code")
    return (
        lines.where(opened).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "code_language"))).alias("f"))
        .select(key, F.explode(F.sequence(F.lit(0), F.ceil(F.size("f") / 2).cast("int") - 1)).alias("i"), "f")
        .select(
            key, (F.col("i") + 1).cast("long").alias("block"), F.col("f")[F.col("i") * 2]["line_no"].alias("start_line"),
            F.get("f", F.col("i") * 2 + 1)["line_no"].alias("end_line"), F.col("f")[F.col("i") * 2]["code_language"].alias("language"),
        )
    )


def _weight(severity: Column, weights: dict[str, int], default: int) -> Column:
    out = F
    for name, value in weights.items():
        out = out.when(severity == name, value)
    return out.otherwise(default)


def _grown(severity: str, weights: dict[str, int], factor: float, default: int) -> Column:
    return (_weight(F.col(severity), weights, default) * (F.lit(1.0) + F.log2("n") * F.lit(factor))).cast("long")


def rule_scores(
    findings: DataFrame, keys: Sequence[str], severity: str, order: Sequence[str],
    weights: dict[str, int], factor: float, default: int,
) -> DataFrame:
    """Score of each rule: weight of its first finding, grown by the log of the count."""
    per_rule = findings.groupBy(*keys, "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(severity, F.struct(*order)).alias("severity")
    )
    return per_rule.withColumn("score", _grown("severity", weights, factor, default))


def total_score(scores: DataFrame, keys: Sequence[str], name: str = "risk_score") -> DataFrame:
    """Sum of the rule scores, at most 100."""
    return scores.groupBy(*keys).agg(F.least(F.sum("score"), F.lit(100)).cast("long").alias(name))


def risk_level(score: Column) -> Column:
    """T23."""
    out = F
    for limit, level in V.RISK_THRESHOLDS:
        out = out.when(score <= limit, level)
    return out.otherwise("blocked")


def scan_units(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Score and level per unit; three critical findings block it.

    ``files`` has (unit, path); ``findings`` has unit, path, line_no, rule_id, severity, pattern_idx.
    Findings are read once: per rule first, then per unit.
    """
    per_rule = findings.groupBy("unit", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("criticals"),
        F.min_by("severity", F.struct("path", "line_no", "pattern_idx")).alias("severity"))
    scored = per_rule.withColumn("score", _grown("severity", V.LINE_WEIGHTS, V.LINE_FACTOR, 5))
    totals = scored.groupBy("unit").agg(
        F.least(F.sum("score"), F.lit(100)).alias("risk_score"), F.sum("n").alias("findings"), F.sum("criticals").alias("criticals"))
    units = files.groupBy("unit").agg(F.count(F.lit(1)).alias("files_scanned"))
    j = units.join(totals, "unit", "left").fillna(0, ["risk_score", "findings", "criticals"])
    blocked = F.col("criticals") >= V.BLOCKING_CRITICALS
    score = F.when(blocked, 100).otherwise(F.col("risk_score")).cast("long")
    return j.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score"))).withColumn(
        "blocked", F.col("risk_level") == "blocked"
    )


def context_scan_units(files: DataFrame, lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Adjusted and original score, blocks, findings in code and adjustments per unit."""
    order = F.struct("ext", "path", "line_no", "pattern_idx")
    per_rule = findings.groupBy("unit", "rule_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("adjusted_severity", order).alias("adjusted"),
        F.min_by("original_severity", order).alias("original"),
        F.count_if("in_code").alias("findings_in_code"),
        F.count_if(F.col("original_severity") != F.col("adjusted_severity")).alias("adjustments"),
    )
    totals = per_rule.groupBy("unit").agg(
        F.least(F.sum(_grown("adjusted", V.CONTEXT_WEIGHTS, V.CONTEXT_FACTOR, 3)), F.lit(100)).alias("risk_score"),
        F.least(F.sum(_grown("original", V.CONTEXT_WEIGHTS, V.CONTEXT_FACTOR, 3)), F.lit(100)).alias("original_risk_score"),
        F.sum("n").alias("findings"), F.sum("findings_in_code").alias("findings_in_code"), F.sum("adjustments").alias("adjustments"),
    )
    blocks = (
        lines.where("is_fence").groupBy("unit", "path").agg(F.ceil(F.count(F.lit(1)) / 2).alias("blocks"))
        .groupBy("unit").agg(F.sum("blocks").alias("code_blocks"))
    )
    units = files.groupBy("unit").agg(F.count(F.lit(1)).alias("files_scanned"))
    j = units.join(totals, "unit", "left").join(blocks, "unit", "left")
    j = j.fillna(0, ["risk_score", "original_risk_score", "findings", "findings_in_code", "adjustments", "code_blocks"])
    return j.withColumn("risk_level", risk_level(F.col("risk_score"))).withColumn("blocked", F.col("risk_level") == "blocked")


def severity_summary(findings: DataFrame, severity: str, keys: Sequence[str]) -> DataFrame:
    """Findings per severity, zero where there is none, and inside or outside code."""
    return findings.groupBy(*keys).agg(
        *[F.count_if(F.col(severity) == s).alias(s) for s in V.SEVERITIES],
        F.count_if("in_code").alias("in_code"),
        F.count_if(~F.col("in_code")).alias("in_prose"),
    )


def blocked_source(path: Column, name: Column) -> Column:
    """Reason why a source is blocked, null if it is not."""
    text = F.lower(F.concat_ws(" ", path, name))
    out = F
    for pattern, reason in V.BLOCKED_SOURCES:
        out = out.when(text.rlike(f"(?iu){pattern}"), reason)
    return out.otherwise(None)

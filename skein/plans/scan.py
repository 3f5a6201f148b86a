"""Scanner queries over all documents and all pages, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scan_values as V
from skein.functions import text as X
from skein.operators import scan as S
from skein.operators import text as D
from skein.plans.corpus import CORPUS_SQL, scan_corpus
from skein.plans.registry import Tables, query

W = "WITH " + CORPUS_SQL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits_sql(rules, source: str) -> str:
    """All (rule, pattern) hits of a line as a list, with constant patterns."""
    cases = ", ".join(
        f"CASE WHEN regexp_matches(line, {lit(p)}, 'i') THEN {{'rule_id': '{r.rule_id}', 'severity': '{r.severity}', 'pattern_idx': {i}::BIGINT, 'pattern': {lit(p)}}} END"
        for r in rules for i, p in enumerate(r.patterns)
    )
    return f"(SELECT * EXCLUDE (hit), unnest(hit) FROM (SELECT *, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS hit FROM {source}))"


def level_sql(score: str) -> str:
    return f"CASE WHEN {score} <= 10 THEN 'safe' WHEN {score} <= 30 THEN 'low' WHEN {score} <= 50 THEN 'medium' WHEN {score} <= 80 THEN 'high' WHEN {score} <= 99 THEN 'critical' ELSE 'blocked' END"


def weight_sql(column: str, weights: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " END"


FOUND = W + f", found AS MATERIALIZED {hits_sql(V.LINE_RULES, 'cl')}"
CONTEXT = W + f""", cf0 AS MATERIALIZED {hits_sql(V.CONTEXT_RULES, 'clines')},
cf AS MATERIALIZED (SELECT *, severity AS original_severity, CASE WHEN in_code THEN CASE severity WHEN 'critical' THEN 'low' ELSE 'info' END ELSE severity END AS adjusted_severity,
  regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS st FROM cf0)
"""


def corpus_lines(t: Tables, rules) -> DataFrame:
    """Lines of the corpus, marked with the patterns of the rules that can occur in their document."""
    return D.explode_lines(S.with_candidates(scan_corpus(t), rules))


def context_lines(t: Tables) -> DataFrame:
    return D.lines_with_context(scan_corpus(t), "path")


def contextual(t: Tables) -> DataFrame:
    return S.contextual_findings(D.lines_with_context(S.with_candidates(scan_corpus(t), V.CONTEXT_RULES), "path"))


@query("j6_line_findings", FOUND + " SELECT unit, path, line_no, rule_id, severity, pattern_idx FROM found")
def _(t):
    return S.scan_lines(corpus_lines(t, V.LINE_RULES), V.LINE_RULES).select("unit", "path", "line_no", "rule_id", "severity", "pattern_idx")


CUSTOM = [("LIC1", "licence line", "info", 0, r"licensed\s+under|released\s+under"), ("PII1", "e-mail address", "medium", 0, r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+"),
          ("PII1", "e-mail address", "medium", 1, r"\b\d{3}-\d{2}-\d{4}\b"), ("PII2", "phone number", "low", 0, r"\(\d{3}\)\s\d{3}-\d{4}\b"),
          ("PII2", "phone number", "low", 1, r"\x2b1\s[(]\d{3}[)]")]


@query("x1_custom_rule_pack", W + f"""
SELECT unit, path, line_no, rule_id, pattern_idx FROM {hits_sql(
    (V.Rule("LIC1", "", "info", (CUSTOM[0][4],)), V.Rule("PII1", "", "medium", (CUSTOM[1][4], CUSTOM[2][4])), V.Rule("PII2", "", "low", (CUSTOM[3][4], CUSTOM[4][4]))), 'cl')}""")
def _(t):
    rows = t.spark.createDataFrame(CUSTOM, "rule_id string, rule_name string, severity string, pattern_idx int, pattern string")
    return S.scan_pack(D.explode_lines(scan_corpus(t)), rows).select("unit", "path", "line_no", "rule_id", "pattern_idx")


@query("t26_match_details", CONTEXT + """
SELECT path, line_no, rule_id, pattern_idx, regexp_extract(line, pattern, 0, 'i') AS match_text,
  length(regexp_extract(line, '(?s)^(.*?)(?:' || pattern || ')', 1, 'i')) AS match_pos FROM cf""")
def _(t):
    found = S.scan_lines(corpus_lines(t, V.CONTEXT_RULES), V.CONTEXT_RULES)
    return S.match_details(found).select("path", "line_no", "rule_id", "pattern_idx", "match_text", "match_pos")


@query("j7_context_findings", CONTEXT + """
SELECT path, line_no, rule_id, pattern_idx, in_code, code_language, original_severity, adjusted_severity FROM cf""")
def _(t):
    return contextual(t).select(
        "path", "line_no", "rule_id", "pattern_idx", "in_code", "code_language", "original_severity", "adjusted_severity")


@query("j7_code_spans", W + """
, f AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k, code_language FROM clines WHERE is_fence)
SELECT a.path, (a.k + 1) // 2 AS block, a.line_no AS start_line, b.line_no AS end_line, a.code_language AS language
FROM f a LEFT JOIN f b ON a.path = b.path AND b.k = a.k + 1 WHERE a.k % 2 = 1""")
def _(t):
    return S.code_spans(context_lines(t), "path")


@query("t24_adjustment_reasons", CONTEXT + """
SELECT path, line_no, rule_id, pattern_idx, CASE WHEN in_code THEN 'Pattern found inside code block (' || coalesce(nullif(code_language, ''), 'unknown') ||
  ' code example). Severity reduced from ' || original_severity || ' to ' || adjusted_severity || '.' ELSE 'Pattern found in prose text - full severity applied.' END AS adjustment_reason FROM cf""")
def _(t):
    return contextual(t).select("path", "line_no", "rule_id", "pattern_idx", "adjustment_reason")


@query("t25_context_types", W + """
, s AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS st FROM clines)
SELECT unit, CASE WHEN in_code THEN 'code_block' WHEN st LIKE '#%' THEN 'heading' WHEN st LIKE '>%' THEN 'blockquote'
  WHEN regexp_matches(st, '^([-*+]|\\d+\\.)') THEN 'list_item' ELSE 'prose' END AS context_type, count(*) AS lines FROM s GROUP BY ALL""")
def _(t):
    return context_lines(t).groupBy("unit", S.context_type().alias("context_type")).agg(F.count(F.lit(1)).alias("lines"))


@query("a6_severity_summary", CONTEXT + f"""
SELECT unit, {", ".join(f"count_if(adjusted_severity = '{s}')::BIGINT AS {s}" for s in V.SEVERITIES)}, count_if(in_code)::BIGINT AS in_code,
  count_if(NOT in_code)::BIGINT AS in_prose FROM cf GROUP BY unit""")
def _(t):
    return S.severity_summary(contextual(t), "adjusted_severity", ["unit"])


@query("a7_rule_scores", FOUND + f"""
SELECT unit, rule_id, n, trunc({weight_sql('severity', V.LINE_WEIGHTS)} * (1 + log2(n) * 0.5))::BIGINT AS score
FROM (SELECT unit, rule_id, any_value(severity) AS severity, count(*) AS n FROM found GROUP BY unit, rule_id)""")
def _(t):
    found = S.scan_lines(corpus_lines(t, V.LINE_RULES), V.LINE_RULES)
    order = ["path", "line_no", "pattern_idx"]
    return S.rule_scores(found, ["unit"], "severity", order, V.LINE_WEIGHTS, V.LINE_FACTOR, 5).drop("severity")


@query("a9_scan_units", FOUND + f"""
, r AS (SELECT unit, severity, count(*) AS n FROM found GROUP BY unit, rule_id, severity),
s AS (SELECT unit, least(sum(trunc({weight_sql('severity', V.LINE_WEIGHTS)} * (1 + log2(n) * 0.5))), 100)::BIGINT AS score,
  sum(n)::BIGINT AS findings, coalesce(sum(n) FILTER (severity = 'critical'), 0)::BIGINT AS criticals FROM r GROUP BY unit),
u AS (SELECT unit, count(*) AS files_scanned FROM corpus GROUP BY unit),
j AS (SELECT u.unit, files_scanned, coalesce(findings, 0) AS findings, coalesce(criticals, 0) AS criticals,
  CASE WHEN criticals >= 3 THEN 100 ELSE coalesce(score, 0) END AS risk_score FROM u LEFT JOIN s USING (unit))
SELECT *, {level_sql('risk_score')} AS risk_level, risk_score = 100 AS blocked FROM j""")
def _(t):
    files = scan_corpus(t).select("unit", "path")
    return S.scan_units(files, S.scan_lines(corpus_lines(t, V.LINE_RULES), V.LINE_RULES))


@query("a8_context_scan_units", CONTEXT + f"""
, r AS (SELECT unit, rule_id, any_value(original_severity) AS o, arg_min(adjusted_severity, (ext, path, line_no, pattern_idx)) AS a, count(*) AS n FROM cf GROUP BY unit, rule_id),
s AS (SELECT unit, least(sum(trunc({weight_sql('a', V.CONTEXT_WEIGHTS)} * (1 + log2(n) * 0.3))), 100)::BIGINT AS risk_score,
  least(sum(trunc({weight_sql('o', V.CONTEXT_WEIGHTS)} * (1 + log2(n) * 0.3))), 100)::BIGINT AS original_risk_score FROM r GROUP BY unit),
c AS (SELECT unit, count(*) AS findings, count_if(in_code)::BIGINT AS findings_in_code, count_if(original_severity <> adjusted_severity)::BIGINT AS adjustments FROM cf GROUP BY unit),
b AS (SELECT unit, sum(n)::BIGINT AS code_blocks FROM (SELECT unit, path, (count(*) + 1) // 2 AS n FROM clines WHERE is_fence GROUP BY ALL) GROUP BY unit),
j AS (SELECT u.unit, files_scanned, coalesce(risk_score, 0) AS risk_score, coalesce(original_risk_score, 0) AS original_risk_score, coalesce(findings, 0) AS findings,
  coalesce(findings_in_code, 0) AS findings_in_code, coalesce(adjustments, 0) AS adjustments, coalesce(code_blocks, 0) AS code_blocks
  FROM (SELECT unit, count(*) AS files_scanned FROM corpus GROUP BY unit) u LEFT JOIN s USING (unit) LEFT JOIN c USING (unit) LEFT JOIN b USING (unit))
SELECT *, {level_sql('risk_score')} AS risk_level, risk_score = 100 AS blocked FROM j""")
def _(t):
    return S.context_scan_units(scan_corpus(t).select("unit", "path"), context_lines(t), contextual(t))


@query("t22_blocked_sources", """
SELECT page_id, CASE WHEN regexp_matches(x, 'malware', 'i') THEN 'Contains ''malware'' keyword' WHEN regexp_matches(x, 'exploit', 'i') THEN 'Contains ''exploit'' keyword'
  WHEN regexp_matches(x, 'hack(er|ing)?', 'i') THEN 'Contains hacking-related keyword' END AS reason
FROM (SELECT page_id, url || ' ' || ['Hacker guide', 'plain', 'exploit malware', 'Exploits'][page_id % 4 + 1] AS x FROM pages)""")
def _(t):
    name = F.element_at(F.array(*[F.lit(x) for x in ["Hacker guide", "plain", "exploit malware", "Exploits"]]), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", S.blocked_source(F.col("url"), name).alias("reason"))


@query("t23_risk_levels", f"SELECT o_orderkey, {level_sql('(trunc(o_totalprice)::BIGINT % 101)')} AS risk_level FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.risk_level(F.col("o_totalprice").cast("long") % 101).alias("risk_level"))

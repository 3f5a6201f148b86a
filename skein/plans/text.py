"""Decomposition queries over the Markdown documents derived from ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import text_values as V
from skein.operators import text as D
from skein.plans.corpus import MD_SQL, pages_as_markdown
from skein.plans.registry import Tables, query

W = "WITH " + MD_SQL
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def alternation(values) -> str:
    return lit("|".join(values))


def group_case(column: str, groups, default: str) -> str:
    tests = " ".join(f"WHEN regexp_matches({column}, {alternation(w)}) THEN '{name}'" for name, w in groups)
    return f"CASE {tests} ELSE '{default}' END"


def command_test(column: str) -> str:
    starters = words(V.COMMAND_STARTERS)
    token = f"regexp_extract({column}, '^\\s*(\\S+)', 1)"
    norm = f"regexp_replace(lower({token}), ':+$', '')"
    return (f"({norm} IN {starters} OR regexp_extract({norm}, '([^/]+)/*$', 1) IN {starters} "
            f"OR (regexp_matches({token}, '^\\.\\.?/') AND regexp_matches({token}, '[^/]\\.(py|sh)$')))")


LINES = MD_SQL
ITEMS = MD_SQL + f""",
texts AS (SELECT *, {STRIP.format('line')} AS st FROM lines WHERE NOT in_code AND NOT regexp_matches(line, '^#{{1,4}}\\s+.+$')),
cand AS (SELECT *, regexp_matches(st, '^(- |\\* |• )') AS bullet, CASE WHEN regexp_matches(st, '^(- |\\* |• )') THEN regexp_replace(st, '^[-*•]\\s+', '') ELSE st END AS item FROM texts),
items AS MATERIALIZED (SELECT doc_id, line_no, heading, heading_level, item FROM cand
  WHERE CASE WHEN bullet THEN length(item) > 10 ELSE length(item) > 30 END AND NOT {command_test('item')}),
cmds AS MATERIALIZED (SELECT doc_id, line_no, {STRIP.format('line')} AS command FROM lines WHERE in_code AND NOT is_fence AND {command_test('line')})
"""
CLASSIFIED = ITEMS + f""",
cleaned AS (SELECT *, regexp_replace({STRIP.format(f"regexp_replace(item, {lit(V.MARKS)}, '', 'g')")}, '\\*\\*(.+?)\\*\\*', '\\1', 'g') AS clean FROM items),
flags AS (SELECT *, regexp_matches(lower(heading), {alternation(V.DIRECTIVE_HEADING_KEYWORDS)}) AS dsec,
  regexp_matches(lower(clean), {alternation(V.RULE_KEYWORDS)}) AS is_rule,
  regexp_matches(lower(clean), {alternation(V.ACTION_VERBS)})
    OR regexp_replace(regexp_extract(lower(clean), '^\\s*(\\S+)', 1), '[^a-z]', '', 'g') IN {words(V.ACTION_VERBS)} AS is_action
  FROM cleaned WHERE length(clean) >= 15),
kinds AS MATERIALIZED (SELECT *, CASE WHEN is_rule AND NOT dsec THEN 'rule' WHEN is_action AND NOT dsec THEN 'action'
  WHEN dsec OR length(clean) > 50 THEN 'directive' END AS kind FROM flags)
"""
ELEMENTS = CLASSIFIED + f""",
found AS (
  SELECT doc_id, line_no, 0 AS part, 'action' AS kind, 'Run ' || regexp_extract(command, '^(\\S+)', 1) AS name, command AS description,
    'external_call' AS element_type, NULL AS condition
  FROM cmds
  UNION ALL
  SELECT doc_id, line_no, 1, kind, clean, clean,
    CASE kind WHEN 'action' THEN {group_case('lower(clean)', V.ACTION_TYPE_KEYWORDS, V.DEFAULT_ACTION_TYPE)}
      WHEN 'directive' THEN {group_case('lower(clean)', V.DIRECTIVE_TYPE_KEYWORDS, V.DEFAULT_DIRECTIVE_TYPE)} END,
    CASE WHEN kind = 'rule' THEN CASE WHEN heading <> '' THEN lower(heading) ELSE 'general' END END
  FROM kinds WHERE kind IS NOT NULL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, lower(name) ORDER BY part, line_no) rn FROM found) WHERE rn = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY part, line_no) AS place FROM firsts),
elements AS MATERIALIZED (SELECT doc_id, kind, left(kind, 1) || '_' || lpad(place::VARCHAR, greatest(3, length(place::VARCHAR))::INTEGER, '0') AS element_id, line_no, name, description, element_type, condition
  FROM placed)
"""


def md(t: Tables) -> DataFrame:
    return pages_as_markdown(t)


def md_lines(t: Tables) -> DataFrame:
    return D.lines_with_context(md(t).select("doc_id", X.body_text(F.col("text")).alias("text")), "doc_id")


@query("s3_lines", """
SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents""")
def _(t):
    return D.explode_lines(t.spread("documents").select("doc_id", "text"))


@query("t2_frontmatter", W + """
SELECT doc_id, regexp_extract(line, '^([^:]*):', 1) AS key, trim(trim(trim(regexp_extract(line, '^[^:]*:(.*)$', 1)), '"'), '''') AS value
FROM (SELECT doc_id, unnest(string_split(front, chr(10))) AS line FROM body) WHERE contains(line, ':')""")
def _(t):
    return md(t).select("doc_id", F.explode(X.frontmatter(F.col("text"))).alias("key", "value"))


@query("t3_headings", W + """
SELECT doc_id, line_no, length(regexp_extract(s, '^(#{1,6})\\s+(.+)$', 1)) AS level,
  regexp_replace(regexp_extract(s, '^(#{1,6})\\s+(.+)$', 2), '^\\s+|\\s+$', '', 'g') AS heading
FROM (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM raw_lines) WHERE regexp_matches(s, '^#{1,6}\\s+.+$')""")
def _(t):
    return D.headings(md(t).select("doc_id", X.body_text(F.col("text")).alias("text")))


@query("t4_code_blocks", W + """
, b AS (SELECT doc_id, regexp_extract_all(text, '(?s)```(\\w*)\\n(.*?)```') AS blocks FROM md)
SELECT doc_id, i - 1 AS position, coalesce(nullif(regexp_extract(blocks[i], '^```(\\w*)', 1), ''), 'unknown') AS language,
  regexp_replace(regexp_extract(blocks[i], '(?s)^```\\w*\\n(.*?)```$', 1), '^\\s+|\\s+$', '', 'g') AS code
FROM b, generate_series(1, len(blocks)) AS g(i)""")
def _(t):
    return md(t).select("doc_id", F.posexplode(X.code_blocks(F.col("text"))).alias("position", "b")).select(
        "doc_id", F.col("position").cast("long").alias("position"), "b.language", "b.code")


@query("w10_fence_state", W + "SELECT doc_id, line_no, is_fence, in_code, code_language FROM lines")
def _(t):
    return md_lines(t).select("doc_id", "line_no", "is_fence", "in_code", "code_language")


@query("w11_section_items", "WITH " + ITEMS + "SELECT doc_id, line_no, heading, heading_level, item FROM items")
def _(t):
    return D.section_items(md_lines(t)).select("doc_id", "line_no", "heading", "heading_level", "item")


@query("t8_code_commands", "WITH " + ITEMS + "SELECT doc_id, line_no, command FROM cmds")
def _(t):
    return D.code_commands(md_lines(t)).select("doc_id", "line_no", "command")


@query("t5_keywords", f"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '`[^`]+`', ' ', 'g') AS x FROM documents),
d AS (SELECT doc_id, regexp_replace(lower(x), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS x FROM c),
k AS (SELECT doc_id, unnest(regexp_extract_all(x, '(?:^|[^\\p{{L}}\\p{{N}}_])([a-zA-Z][a-zA-Z0-9_-]+[a-zA-Z0-9_])(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS word FROM d)
SELECT doc_id, count(*) AS n_keywords, count(DISTINCT word) AS n_distinct FROM k WHERE word NOT IN {words(V.KEYWORD_STOPWORDS)} GROUP BY doc_id""")
def _(t):
    k = t.spread("documents").select("doc_id", X.keywords(F.col("text")).alias("k")).where(F.size("k") > 0)
    return k.select("doc_id", F.size("k").cast("long").alias("n_keywords"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"))


@query("t6_element_types", "WITH " + ITEMS + f"""
SELECT doc_id, line_no, {group_case('lower(item)', V.ACTION_TYPE_KEYWORDS, V.DEFAULT_ACTION_TYPE)} AS action_type,
  {group_case('lower(item)', V.DIRECTIVE_TYPE_KEYWORDS, V.DEFAULT_DIRECTIVE_TYPE)} AS directive_type FROM items""")
def _(t):
    item = F.col("item")
    return D.section_items(md_lines(t)).select(
        "doc_id", "line_no", X.action_type(item).alias("action_type"), X.directive_type(item).alias("directive_type"))


@query("t7_sentence_tests", "WITH " + CLASSIFIED + "SELECT doc_id, line_no, is_rule, is_action FROM kinds")
def _(t):
    clean = F.col("clean")
    items = D.section_items(md_lines(t)).withColumn("clean", X.clean_markup(F.col("item"))).where(F.length("clean") >= 15)
    return items.select("doc_id", "line_no", X.is_rule_sentence(clean).alias("is_rule"), X.is_action_sentence(clean).alias("is_action"))


@query("t9_clean_markup", "WITH " + CLASSIFIED + "SELECT doc_id, line_no, clean FROM cleaned")
def _(t):
    return D.section_items(md_lines(t)).select("doc_id", "line_no", X.clean_markup(F.col("item")).alias("clean"))


@query("t10_decomposition", "WITH " + ELEMENTS + "SELECT * FROM elements")
def _(t):
    return D.decompose(md(t), "doc_id")


@query("w9_keep_first", "WITH " + ELEMENTS + "SELECT doc_id, line_no, part, kind, name FROM firsts WHERE part = 1")
def _(t):
    clean = F.col("clean")
    kinds = D.classified_items(D.section_items(md_lines(t)))
    named = kinds.select("doc_id", "line_no", F.lit(1).alias("part"), "kind", clean.alias("name"))
    return D.keep_first(named, ["doc_id", "kind"], F.col("name"), ["part", "line_no"])


@query("w12_element_ids", "WITH " + ELEMENTS + "SELECT doc_id, kind, count(*) AS n, max(element_id) AS last_id FROM elements GROUP BY ALL")
def _(t):
    return D.decompose(md(t), "doc_id").groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("element_id").alias("last_id"))


@query("t11_names", """
SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug,
  CASE WHEN c = '' THEN 'Document ' || doc_id ELSE left(array_to_string(string_split(c, ' ')[1:6], ' ') || CASE WHEN len(string_split(c, ' ')) > 6 THEN '...' ELSE '' END, 80) END AS short_name
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(lower(head), '-', '_'), '[^a-z_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s,
    regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^[ .:-]+|[ .:-]+$', '', 'g') AS c
  FROM (SELECT doc_id, text, regexp_extract(text, '^[^\\n]*', 0) AS head FROM documents))""")
def _(t):
    d = t.spread("documents")
    fallback = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    return d.select("doc_id", X.slug(F.regexp_extract("text", "^[^\\n]*", 0)).alias("slug"), X.short_name(F.col("text"), fallback).alias("short_name"))


@query("t12_condition_types", f"""
SELECT doc_id, {group_case("lower(concat_ws(' ', text, source))", V.CONDITION_TYPE_KEYWORDS, V.DEFAULT_CONDITION_TYPE)} AS condition_type,
  CASE doc_id % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'score' WHEN 2 THEN 'classification' WHEN 3 THEN 'enum_value' WHEN 4 THEN 'boolean' ELSE 'boolean' END AS returns
FROM documents""")
def _(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in ["Proceed_or_halt", "risk score", " CLASS ", "an enum", "", "other"]]),
                       (F.col("doc_id") % 6 + 1).cast("int"))
    return t.spread("documents").select("doc_id", X.condition_type(F.col("text"), F.col("source")).alias("condition_type"), X.returns_type(raw).alias("returns"))


@query("t13_skill_ids", """
WITH r AS (SELECT c_custkey, c_name, ['claude__skill__ok', 'mcp__bad id', '', 'other__x__y'][c_custkey % 4 + 1] AS cur,
  ['claude_skill', 'mcp_tool', 'mcp_server_internal'][c_custkey % 3 + 1] AS layer FROM customer)
SELECT c_custkey, CASE WHEN cur = 'claude__skill__ok' THEN cur ELSE
  CASE WHEN layer LIKE 'mcp%' OR cur LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp' ELSE 'claude' END || '__' ||
  CASE layer WHEN 'mcp_tool' THEN 'tool' WHEN 'mcp_server_internal' THEN 'server_internal' ELSE 'skill' END || '__' || 'customer' END AS skill_id FROM r""")
def _(t):
    def pick(values, by):
        return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("c_custkey") % by + 1).cast("int"))

    cur = pick(["claude__skill__ok", "mcp__bad id", "", "other__x__y"], 4)
    return t.customer.select("c_custkey", X.skill_id(cur, pick(V.LAYERS, 3), F.col("c_name")).alias("skill_id"))


REFS = MD_SQL + f""",
refs0 AS (
  SELECT doc_id, 1 AS grp, generate_subscripts(m, 1) AS k, unnest(m) AS p FROM (SELECT doc_id, regexp_extract_all(text, '\\[[^\\]]+\\]\\(([^)]+)\\)', 1) AS m FROM body)
  UNION ALL SELECT doc_id, 2, generate_subscripts(m, 1), unnest(m) FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`([^`\\n]+)`', 1) AS m FROM body)
  UNION ALL SELECT doc_id, 3, generate_subscripts(m, 1), regexp_replace(trim(regexp_extract(unnest(m), '^[^:]*:(.*)$', 1)), '^"|"$', '', 'g')
    FROM (SELECT doc_id, string_split(front, chr(10)) AS m FROM body)),
refs1 AS (SELECT *, trim(p) AS path, lower(regexp_extract(trim(p), '[^/.]([^/]*?)(\\.[^/.]+)$', 2)) AS sfx FROM refs0),
refs2 AS (SELECT * FROM refs1 WHERE NOT regexp_matches(path, '^(http://|https://|/|#)') AND NOT (contains(path, ' ') AND NOT regexp_matches(path, '[/\\\\]'))
  AND (sfx IN {words(V.PATH_EXTENSIONS)} OR contains(path, '/'))),
refs3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY grp, k) AS rn FROM refs2),
refs AS MATERIALIZED (SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY grp, k)::BIGINT AS place,
  CASE WHEN contains(lower(path), 'template') OR sfx = '.tmpl' THEN 'template' WHEN contains(lower(path), 'script') OR sfx IN ('.py','.sh','.mjs','.js','.ts') THEN 'script'
    WHEN sfx IN ('.json','.yaml','.yml','.toml') THEN 'config' WHEN sfx IN ('.md','.txt') THEN 'reference' ELSE 'unknown' END AS file_kind FROM refs3 WHERE rn = 1),
resolved AS (SELECT refs.*, path IN (SELECT 'docs/' || regexp_extract(html, '<li><a href="/([^"]*)">', 1) || '.md' FROM pages WHERE page_id % 2 = 0) AS resolved FROM refs)
"""


def inventory(t: Tables) -> DataFrame:
    first = F.regexp_extract("html", '<li><a href="/([^"]*)">', 1)
    return t.pages.where(F.col("page_id") % 2 == 0).select(F.concat(F.lit("docs/"), first, F.lit(".md")).alias("path"))


def resolved(t: Tables) -> DataFrame:
    return D.resolved_references(D.references(md(t), "doc_id"), inventory(t))


@query("t16_references", "WITH " + REFS + "SELECT doc_id, place, path, file_kind FROM refs")
def _(t):
    return D.references(md(t), "doc_id")


@query("j14_resolved_references", "WITH " + REFS + "SELECT doc_id, path, resolved FROM resolved")
def _(t):
    return resolved(t).select("doc_id", "path", "resolved")


COMMANDS = ITEMS + f""",
auth AS (SELECT *, {group_case('lower(command)', V.AUTHORITY_TOKENS, 'unknown_authority')} AS authority_profile FROM cmds),
commands AS MATERIALIZED (SELECT *, CASE lower(regexp_extract(command, '^(\\S+)', 1)) WHEN 'python3' THEN 'python' WHEN 'bash' THEN 'posix_shell' WHEN 'sh' THEN 'posix_shell'
    ELSE lower(regexp_extract(command, '^(\\S+)', 1)) END AS shell_family,
  CASE WHEN authority_profile = 'system_mutation' THEN 'high' WHEN authority_profile IN ('network_call', 'process_exec') THEN 'medium'
    WHEN authority_profile = 'file_write' AND contains(lower(command), '--force') THEN 'medium' ELSE 'low' END AS risk_grade FROM auth)
"""


@query("t17_command_references", "WITH " + COMMANDS + "SELECT doc_id, line_no, command, shell_family, authority_profile, risk_grade FROM commands")
def _(t):
    return D.command_references(md(t), "doc_id")


SIGNALS = """,
signals AS MATERIALIZED (SELECT doc_id, 'fork_context' AS signal, NULL::VARCHAR AS agent FROM md WHERE doc_id % 3 = 2
  UNION ALL SELECT doc_id, 'named_agent', 'reviewer' FROM md WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 'subagent_reference', CASE WHEN doc_id % 3 = 1 THEN 'reviewer' END FROM body WHERE regexp_matches(text, '(?i)\\b(subagent|delegate|delegation)\\b'))
"""


@query("t19_delegations", W + SIGNALS + "SELECT * FROM signals")
def _(t):
    return D.delegations(md(t), "doc_id")


_ANALYSIS = "WITH " + COMMANDS + REFS.replace(MD_SQL, "") + SIGNALS


@query("t18_analysis_findings", _ANALYSIS + """
SELECT doc_id, 'Unresolved reference: ' || path AS title, 'reference_integrity' AS category, 'medium' AS severity, 'high' AS confidence,
  'resolve_reference' AS recommended_action FROM resolved WHERE NOT resolved
UNION ALL SELECT doc_id, 'Authority-bearing command: ' || command, 'execution_authority', risk_grade, 'high', 'review_before_run' FROM commands WHERE risk_grade <> 'low'
UNION ALL SELECT DISTINCT doc_id, 'Delegation path present', 'control_flow', 'info', 'high', 'confirm_scope' FROM signals
UNION ALL SELECT doc_id, 'All supporting references are unresolved', 'hidden_dependency', 'medium', 'medium', 'document_dependency'
  FROM resolved GROUP BY doc_id HAVING NOT bool_or(resolved)""")
def _(t):
    return D.analysis_findings(resolved(t), D.command_references(md(t), "doc_id"), D.delegations(md(t), "doc_id"), "doc_id")


@query("a34_manifest_rollup", _ANALYSIS + """
SELECT doc_id, (SELECT count(*) FROM refs r WHERE r.doc_id = md.doc_id) AS supporting_files,
  (SELECT count(*) FROM resolved r WHERE r.doc_id = md.doc_id AND NOT resolved) AS unresolved,
  (SELECT count(*) FROM commands c WHERE c.doc_id = md.doc_id) AS commands, (SELECT count(*) FROM signals s WHERE s.doc_id = md.doc_id) AS delegations FROM md""")
def _(t):
    d = md(t)
    return D.manifest_rollup(d, resolved(t), D.command_references(d, "doc_id"), D.delegations(d, "doc_id"), "doc_id")


def _goal_sql() -> str:
    sums = [" + ".join(f"contains(x, {lit(w.lower())})::INT" for w in ws) for _, ws in V.GOAL_KEYWORDS]
    return "[" + ", ".join(sums) + "]"


@query("t37_goals", f"""
WITH s AS (SELECT conv_id, turn, {_goal_sql()} AS scores FROM (SELECT *, lower(text) AS x FROM conversations)),
g AS (SELECT conv_id, turn, CASE WHEN list_max(scores) = 0 THEN 'discover' ELSE [{", ".join(f"'{n}'" for n, _ in V.GOAL_KEYWORDS)}][list_position(scores, list_max(scores))] END AS goal FROM s)
SELECT conv_id, turn, goal, CASE WHEN goal IN ('discover', 'compare') THEN 'triage' WHEN goal IN ('govern', 'validate') THEN 'review' ELSE 'execution' END AS phase FROM g""")
def _(t):
    return t.conversations.select("conv_id", "turn", X.goal(F.col("text")).alias("goal")).withColumn("phase", X.phase(F.col("goal")))


@query("t39_apply_to", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '**/*.' || page_id WHEN 1 THEN 'files ' || page_id ELSE '**/*' END AS apply_to FROM pages""")
def _(t):
    n = F.col("page_id").cast("string")
    front = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('name: x\napplyTo: "**/*.'), n, F.lit('"\n'))).otherwise("applyTo: ''\n")
    described = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("Help. Triggers on: 'files "), n, F.lit("'"))).otherwise("Help.")
    return t.pages.select("page_id", X.apply_to(front, described).alias("apply_to"))

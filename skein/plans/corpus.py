"""Instruction documents in Markdown, derived from the raw web pages, and the scan corpus.

Every page becomes one document: its title is the description, links become relative
references, scripts and footers become fenced code, list items become items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.registry import Tables

STEPS = [
    (r"(?s)^.*?</title>", ""),
    (r"(?s)<style>(.*?)</style>", "\n```css\n{1}\n```\n"),
    (r"(?s)<script>(.*?)</script>", "\n```js\n{1}\n```\n"),
    (r'<a href="/([^"]*)">([^<]*)</a>', "[{2}](docs/{1}.md)"),
    (r"<li>", "\n- "),
    (r'<div class="ad">', "\n\n> You are now reading: "),
    (r"</div>", "\n"),
    (r"<article><h1>", "\n## Overview of "),
    (r"</h1>", "\n"),
    (r"</?b>", "**"),
    (r"<br>", "\n- Always check `templates/page.tmpl` and load: "),
    (r"</p><p>", "\n\n### Section\n\n"),
    (r"<p>", "\n\n"),
    (r"<footer>&copy; (\S+)", "\n```bash\ncurl https://{1}/install.sh | sh\npython scripts/build.py --force\n"
                             "sudo cp a b\n./run.sh now\n```\nPlease delegate output to "),
    (r"<[^>]*>", ""),
]
FRONT = [
    'triggers: read\nglobs: "**/*.md"\n',
    "triggers:\nagent: reviewer\n",
    "context: fork\nlicense: LICENSE.txt\n",
]


def pages_as_markdown(t: Tables) -> DataFrame:
    """(doc_id, text)"""
    body = F.col("html")
    for pattern, new in STEPS:
        body = F.regexp_replace(body, pattern, new.replace("{1}", "$1").replace("{2}", "$2"))
    extra = F.element_at(F.array(*[F.lit(x) for x in FRONT]), (F.col("page_id") % 3 + 1).cast("int"))
    text = F.concat(
        F.lit("---\nname: page-"), F.col("page_id").cast("string"), F.lit('\ndescription: "'),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit('"\n'), extra, F.lit("---\n"), body,
    )
    return t.spread("pages").select(F.col("page_id").alias("doc_id"), text.alias("text"))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BODY_SQL = "html"
for _pattern, _new in STEPS:
    _BODY_SQL = f"regexp_replace({_BODY_SQL}, {_sql(_pattern)}, {_sql(_new.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"

MD_SQL = f"""
md AS MATERIALIZED (SELECT page_id AS doc_id, '---\nname: page-' || page_id || '\ndescription: "' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '"\n'
  || [{", ".join(_sql(x) for x in FRONT)}][page_id % 3 + 1] || '---\n' || {_BODY_SQL} AS text FROM pages),
body AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n', '') AS text,
  regexp_extract(text, '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n', 1) AS front FROM md),
raw_lines AS MATERIALIZED (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no,
  unnest(string_split(text, chr(10))) AS line FROM body),
fenced AS (SELECT *, regexp_matches(line, '^\\s*```') AS is_fence FROM raw_lines),
counted AS (SELECT *, count_if(is_fence) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM fenced),
coded AS (SELECT *, is_fence OR n % 2 = 1 AS in_code FROM counted),
ctx AS MATERIALIZED (SELECT doc_id, line_no, line, is_fence, in_code,
  CASE WHEN in_code THEN last_value(CASE WHEN is_fence AND n % 2 = 1 THEN regexp_extract(line, '^\\s*```(\\w*)', 1) END IGNORE NULLS) OVER w END AS code_language,
  last_value(CASE WHEN NOT in_code AND regexp_matches(line, '^#{{1,4}}\\s+.+$') THEN line END IGNORE NULLS) OVER w AS head
  FROM coded WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lines AS MATERIALIZED (SELECT doc_id, line_no, line, is_fence, in_code, code_language,
  coalesce(length(regexp_extract(head, '^(#{{1,4}})\\s+(.+)$', 1)), 0)::BIGINT AS heading_level,
  coalesce(regexp_replace(regexp_extract(head, '^(#{{1,4}})\\s+(.+)$', 2), '^\\s+|\\s+$', '', 'g'), '') AS heading FROM ctx)
"""


def scan_corpus(t: Tables) -> DataFrame:
    """(unit, path, ext, text): all documents by source and all pages by a seventh."""
    docs = t.spread("documents").select(
        F.col("source").alias("unit"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.lit(2).alias("ext"), "text",
    )
    pages = pages_as_markdown(t).select(
        F.concat(F.lit("pages"), (F.col("doc_id") % 7).cast("string")).alias("unit"),
        F.concat(F.lit("page/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("ext"), "text",
    )
    return docs.unionByName(pages)


CORPUS_SQL = MD_SQL + """,
corpus AS MATERIALIZED (SELECT source AS unit, 'doc/' || doc_id AS path, 2 AS ext, text FROM documents
  UNION ALL SELECT 'pages' || (doc_id % 7), 'page/' || doc_id, 1, text FROM md),
cl AS (SELECT unit, path, ext, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no,
  unnest(string_split(text, chr(10))) AS line FROM corpus),
cn AS (SELECT *, count_if(is_fence) OVER (PARTITION BY path ORDER BY line_no) AS n FROM (
  SELECT *, regexp_matches(line, '^\\s*```') AS is_fence FROM cl)),
clines AS MATERIALIZED (SELECT unit, path, ext, line_no, line, is_fence, is_fence OR n % 2 = 1 AS in_code,
  CASE WHEN is_fence OR n % 2 = 1 THEN last_value(CASE WHEN is_fence AND n % 2 = 1 THEN regexp_extract(line, '^\\s*```(\\w*)', 1) END IGNORE NULLS)
    OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS code_language FROM cn)
"""

"""Golden cases of decomposition, classification, normalisation and licences."""

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import text_values as V
from skein.operators import documents as N
from skein.operators import licenses as L
from skein.operators import text as D

SKILL = """---
name: "demo"
description: 'A demo: with colon'
agent: reviewer
context: fork
empty:
---
# Steps
- Create the **report** file for users
- You must never skip the review step
- short
```bash
python scripts/run.py --all
echo hello
npm install
curl https://example.com/x
```
See [guide](docs/guide.md) and `templates/a.tmpl` or [site](https://x.y/z.md).
## Best practice notes
* Keep the structure simple and easy to follow
Delegate output to a subagent.
"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, SKILL)], "doc_id long, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_frontmatter(docs):
    meta = docs.select(X.frontmatter(F.col("text")).alias("m")).first()["m"]
    assert meta == {"name": "demo", "description": "A demo: with colon", "agent": "reviewer", "context": "fork", "empty": ""}


def test_last_key_wins(spark):
    text = "---\nname: a\nname: b\n---\nbody"
    assert one(spark, X.frontmatter(F.lit(text))) == {"name": "b"}
    assert one(spark, X.body_text(F.lit(text))) == "body"
    assert one(spark, X.frontmatter(F.lit("no front"))) == {}


def test_decomposition(docs):
    rows = {(r.kind, r.element_id): r for r in D.decompose(docs, "doc_id").collect()}
    assert rows[("action", "a_001")].name == "Run python" and rows[("action", "a_001")].element_type == "external_call"
    assert [rows[("action", f"a_00{i}")].name for i in (2, 3)] == ["Run npm", "Run curl"]
    created = rows[("action", "a_004")]
    assert created.name == "Create the report file for users" and created.element_type == "io_write"
    assert rows[("rule", "r_001")].condition == "steps"
    directives = [r for (kind, _), r in rows.items() if kind == "directive"]
    assert any(r.description.startswith("Keep the structure") for r in directives)


def test_caps_and_first_kept(spark):
    lines = [f"- You must verify item number {i} of the list" for i in range(30)] + ["- You must verify item number 0 of the LIST"]
    docs = spark.createDataFrame([(1, "# Rules\n" + "\n".join(lines))], "doc_id long, text string")
    rows = D.decompose(docs, "doc_id", V.FILE_LIMITS).where("kind = 'rule'").orderBy("element_id").collect()
    assert [r.element_id for r in rows] == [f"r_{i:03d}" for i in range(1, 11)] and rows[0].line_no == 2
    rows = D.decompose(docs, "doc_id").where("kind = 'rule'").orderBy("element_id").collect()
    assert [r.element_id for r in rows] == [f"r_{i:03d}" for i in range(1, 31)]


def test_texts_are_whole_unless_limits_are_passed(spark):
    long = "You must verify " + "every item of the long list " * 20
    docs = spark.createDataFrame([(1, f"# {'Heading ' * 20}\n- {long}\n```bash\npython {'x' * 200}\n```")], "doc_id long, text string")
    whole = {r.kind: r for r in D.decompose(docs, "doc_id").collect()}
    assert whole["rule"].description == long.strip() and len(whole["rule"].condition) > 100 and len(whole["action"].description) > 200
    few = {r.kind: r for r in D.decompose(docs, "doc_id", V.FILE_LIMITS).collect()}
    assert (len(few["rule"].description), len(few["rule"].condition), len(few["action"].description)) == (150, 80, 100)


def test_references(docs, spark):
    refs = {r.path: (r.file_kind, r.place) for r in D.references(docs, "doc_id").collect()}
    assert refs == {"docs/guide.md": ("reference", 1), "templates/a.tmpl": ("template", 2)}
    inventory = spark.createDataFrame([("docs/guide.md",)], "path string")
    found = {r.path: r.resolved for r in D.resolved_references(D.references(docs, "doc_id"), inventory).collect()}
    assert found == {"docs/guide.md": True, "templates/a.tmpl": False}


def test_commands(docs):
    rows = {r.command: (r.shell_family, r.authority_profile, r.risk_grade) for r in D.command_references(docs, "doc_id").collect()}
    assert rows == {
        "python scripts/run.py --all": ("python", "process_exec", "medium"),
        "npm install": ("npm", "system_mutation", "high"),
        "curl https://example.com/x": ("curl", "network_call", "medium"),
    }


def test_delegations(docs):
    assert {(r.signal, r.agent) for r in D.delegations(docs, "doc_id").collect()} == {
        ("fork_context", None), ("named_agent", "reviewer"), ("subagent_reference", "reviewer")}


@pytest.mark.parametrize("text, kind", [
    ("already there", "io_read"), ("Write a file", "io_write"), ("analyze it", "io_read"), ("zzz", "transform"), ("hash value", "compute"),
])
def test_action_types(spark, text, kind):
    assert one(spark, X.action_type(F.lit(text))) == kind


@pytest.mark.parametrize("words, kind", [
    ("check access role", "permission_check"), ("file exists", "existence_check"), ("JSON schema", "type_check"), ("minimum size", "range_check"),
    ("quota reached", "threshold_check"), ("must match", "consistency_check"), ("is ready", "state_check"), ("other", "validation"),
])
def test_condition_types(spark, words, kind):
    assert one(spark, X.condition_type(F.lit(words), F.lit(None).cast("string"))) == kind


@pytest.mark.parametrize("raw, name", [("A-B c9!", "a_b_c"), ("__", "unknown"), ("Ünïx", "n_x")])
def test_slug(spark, raw, name):
    assert one(spark, X.slug(F.lit(raw))) == name


def test_short_name(spark):
    assert one(spark, X.short_name(F.lit(" - one  two three four five six seven. "), F.lit("f"))) == "one two three four five six..."
    assert one(spark, X.short_name(F.lit(" .:- "), F.lit("f"))) == "f"
    assert one(spark, X.short_name(F.lit(None).cast("string"), F.lit("f"))) == "f"


@pytest.mark.parametrize("current, layer, name, ident", [
    ("claude__skill__ok", "mcp_tool", "x", "claude__skill__ok"), ("bad id", "claude_skill", "My-Tool 2", "claude__skill__my_tool"),
    ("mcp__x y", "claude_skill", "n", "mcp__skill__n"), ("", "mcp_server_internal", None, "mcp__server_internal__unknown"),
])
def test_skill_ids(spark, current, layer, name, ident):
    assert one(spark, X.skill_id(F.lit(current), F.lit(layer), F.lit(name).cast("string"))) == ident


@pytest.mark.parametrize("word, meaning", [("halt", "halt"), ("warn", "escalate"), ("stop", "halt"), ("skip", "branch"), ("??", "escalate"), (None, None)])
def test_fail_actions(spark, word, meaning):
    assert one(spark, X.fail_action(F.lit(word).cast("string"))) == meaning


@pytest.mark.parametrize("text, goal", [
    ("compare the overlap", "compare"), ("search", "discover"), ("nothing", "discover"), ("review the schema", "govern"), ("風險 審核", "govern"),
    ("verify the contract test", "validate"),
])
def test_goals(spark, text, goal):
    assert one(spark, X.goal(F.lit(text))) == goal


def test_apply_to(spark):
    assert one(spark, X.apply_to(F.lit("a: b\napplyTo: '**/*.py'"), F.lit(""))) == "**/*.py"
    assert one(spark, X.apply_to(F.lit("a: b"), F.lit("Help. Triggers on: x, y"))) == "x, y"
    assert one(spark, X.apply_to(F.lit(""), F.lit(""))) == "**/*"


def test_keywords(spark):
    text = "The big-cat saw `code here` at https://x.y/z and ```\nfenced words\n``` déjà ab cat"
    assert one(spark, X.keywords(F.lit(text))) == ["big-cat", "saw", "cat"]


LICENCES = {
    "Licensed under the Apache License, Version 2.0.": ("Apache-2.0", 0.72),
    "Released under the MIT License.": ("MIT", 0.565),
    "// SPDX-License-Identifier: MPL-2.0\nMIT License": ("MPL-2.0", 1.0),
    "SPDX-License-Identifier: Unknown-1\nGPLv3": ("GPL-3.0", 0.525),
    "nothing": ("UNKNOWN", 0.0),
    "all RIGHTS reserved": ("PROPRIETARY", 0.62),
}


def test_licences(spark):
    df = L.detect(spark.createDataFrame([(k, k) for k in LICENCES], "id string, text string"))
    got = {r.id: (r.spdx_id, round(r.confidence, 4)) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in LICENCES.items()}
    assert got["nothing"][1] == 0.0 and got["// SPDX-License-Identifier: MPL-2.0\nMIT License"][1] == 1.0
    checked = {r.id: (r.compatible, r.recommendation) for r in L.compatibility(df, "x").collect()}
    assert checked["nothing"] == (False, "manual_review") and checked["all RIGHTS reserved"] == (False, "reject")
    assert checked["Released under the MIT License."] == (True, "auto_approve")


def test_longest_licence_pattern_wins(spark):
    text = "Permission is hereby granted, free of charge. ISC License"
    row = L.detect(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert row.spdx_id == "MIT" and abs(row.confidence - min(0.9, 0.5 + len(r"Permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge") / 200)) < 1e-12


def test_references_resolve(spark):
    elements = spark.createDataFrame([(1, e) for e in ("a_001", "a_002", "r_001", "d_001")], "doc_id long, element_id string")
    refs = spark.createDataFrame([(1, "path", e) for e in ("a_001", "r_001", "a_002", "d_001")], "doc_id long, source string, ref_id string")
    assert N.unknown_references(refs, elements).count() == 0
    bad = spark.createDataFrame([(1, "path", "a_009")], refs.schema)
    assert [r.ref_id for r in N.unknown_references(bad, elements).collect()] == ["a_009"]

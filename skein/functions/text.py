"""Column expressions over text. No Python code runs per row."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text_values as V

FRONTMATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n"


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that later filters refer to instead of repeating their expressions.

    The optimizer moves a filter below a projection by writing the projected expression
    into it, so a costly text expression would run in the filter and again after it. It
    does not do so below a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def strip(c: Column) -> Column:
    """Both ends without white space (``trim`` alone drops only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unquote(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^\"+|\"+$", ""), "^'+|'+$", "")


def any_of(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) if re.search(r"\W", w) else w for w in words)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return c.rlike(any_of(words))


def first_group(c: Column, groups, default: str) -> Column:
    """First group with one of its words as a substring; a group is (name, words)."""
    out = F
    for name, words in groups:
        out = out.when(contains_any(c, words), name)
    return out.otherwise(default)


def frontmatter_text(content: Column) -> Column:
    return F.regexp_extract(content, FRONTMATTER, 1)


def body_text(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def frontmatter(content: Column) -> Column:
    """Key to value map; quotes are stripped and the last value of a key wins."""
    pairs = F.filter(F.split(frontmatter_text(content), "\n", -1), lambda line: line.rlike(r"^\s*[^:\s][^:]*:"))
    return F.map_from_entries(F.transform(pairs, lambda line: F.struct(
        strip(F.regexp_extract(line, "^([^:]*):", 1)),
        unquote(strip(F.regexp_extract(line, "^[^:]*:(.*)$", 1))),
    )))


_PROGRAM = r"(?i)^\s*(?:\S*/)?(?:" + "|".join(V.COMMAND_STARTERS) + r")/*:*(?=\s|$)"
_SCRIPT = r"^\s*\.\.?/\S*[^/\s]\.(?:py|sh)(?=\s|$)"


def is_command(line: Column) -> Column:
    """The first token names a known program, with or without a path, or a local script."""
    return line.rlike(_PROGRAM) | line.rlike(_SCRIPT)


def clean_markup(c: Column) -> Column:
    """Without marks and bold signs."""
    return F.regexp_replace(strip(F.regexp_replace(c, V.MARKS, "")), r"\*\*(.+?)\*\*", "$1")


def is_rule_sentence(c: Column) -> Column:
    """T7."""
    return contains_any(F.lower(c), V.RULE_KEYWORDS)


def is_action_sentence(c: Column) -> Column:
    """T7."""
    lowered = F.lower(c)
    first = F.regexp_replace(F.regexp_extract(lowered, r"^\s*(\S+)", 1), "[^a-z]", "")
    return first.isin(*V.ACTION_VERBS) | contains_any(lowered, V.ACTION_VERBS)


def action_type(c: Column) -> Column:
    """T6."""
    return first_group(F.lower(c), V.ACTION_TYPE_KEYWORDS, V.DEFAULT_ACTION_TYPE)


def directive_type(c: Column) -> Column:
    """T6."""
    return first_group(F.lower(c), V.DIRECTIVE_TYPE_KEYWORDS, V.DEFAULT_DIRECTIVE_TYPE)


def condition_type(*texts: Column) -> Column:
    """Class of a rule from the words of its texts."""
    joined = F.lower(F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in texts]))
    return first_group(joined, V.CONDITION_TYPE_KEYWORDS, V.DEFAULT_CONDITION_TYPE)


def returns_type(value: Column) -> Column:
    """Canonical kind of result."""
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    return (
        F.when(v.isin(*V.RETURNS), v).when(v.isin(*V.RETURNS_AS_BOOLEAN), "boolean")
        .when(v.contains("score"), "score").when(v.contains("class"), "classification")
        .when(v.contains("enum"), "enum_value").otherwise("boolean")
    )


def slug(c: Column) -> Column:
    """Lower-case letters and single underscores."""
    cleaned = F.regexp_replace(F.replace(F.lower(c), F.lit("-"), F.lit("_")), "[^a-z_]+", "_")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, "_+", "_"), "^_+|_+$", "")
    return F.when(cleaned == "", "unknown").otherwise(cleaned)


def short_name(c: Column, fallback: Column) -> Column:
    """The first six words, at most 80 characters."""
    cleaned = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^[ .:-]+|[ .:-]+$", "")
    words = F.split(cleaned, " ")
    name = F.concat(F.array_join(F.slice(words, 1, 6), " "), F.when(F.size(words) > 6, "...").otherwise(""))
    return F.when(F.coalesce(cleaned, F.lit("")) == "", fallback).otherwise(F.substring(name, 1, 80))


def skill_id(current: Column, layer: Column, name: Column) -> Column:
    """A valid id as it is, else one built from layer and name."""
    cur = strip(F.coalesce(current, F.lit("")))
    lay = F.coalesce(layer, F.lit(""))
    provider = F.when(lay.startswith("mcp") | cur.startswith("mcp__"), "mcp").otherwise("claude")
    scope = F.when(lay == "mcp_tool", "tool").when(lay == "mcp_server_internal", "server_internal").otherwise("skill")
    base = F.coalesce(F.nullif(name, F.lit("")), F.nullif(cur, F.lit("")), F.lit("unknown"))
    return F.when(cur.rlike(V.SKILL_ID), cur).otherwise(F.concat_ws("__", provider, scope, slug(base)))


def fail_action(c: Column) -> Column:
    """Canonical reaction; unknown words escalate."""
    out = F.when(F.coalesce(c, F.lit("")) == "", c).when(c.isin(*V.FAIL_ACTIONS), c)
    for word, meaning in V.FAIL_ACTION_SYNONYMS.items():
        out = out.when(c == word, meaning)
    return out.otherwise("escalate")


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.]([^/]*?)(\.[^/.]+)$", 2))


def is_relative_path(c: Column) -> Column:
    """Looks like a path inside the package."""
    outside = c.rlike("^(http://|https://|/|#)")
    prose = c.contains(" ") & ~c.rlike(r"[/\\]")
    return ~outside & ~prose & (suffix(c).isin(*V.PATH_EXTENSIONS) | c.contains("/"))


def file_kind(path: Column) -> Column:
    """Kind of a referenced file by word and extension."""
    out = F
    for kind, word, endings in V.FILE_KINDS:
        test = suffix(path).isin(*endings)
        if word:
            test = F.lower(path).contains(word) | test
        out = out.when(test, kind)
    return out.otherwise("unknown")


def shell_family(command: Column) -> Column:
    """T17."""
    first = F.lower(F.regexp_extract(command, r"^\s*(\S+)", 1))
    return (
        F.when(first.isin("python", "python3"), "python").when(first.isin("bash", "sh"), "posix_shell").otherwise(first)
    )


def authority(command: Column) -> Column:
    """What a command may touch."""
    return first_group(F.lower(command), V.AUTHORITY_TOKENS, "unknown_authority")


def command_risk(command: Column, profile: Column) -> Column:
    """T17."""
    forced = F.lower(command).contains("--force")
    return (
        F.when(profile == "system_mutation", "high")
        .when(profile.isin("network_call", "process_exec"), "medium")
        .when((profile == "file_write") & forced, "medium")
        .otherwise("low")
    )


def keywords(content: Column) -> Column:
    """T5: significant words outside code and links, in text order."""
    text = F.regexp_replace(content, "(?s)```.*?```", " ")
    text = F.regexp_replace(text, r"https?://\S+", " ")
    text = F.regexp_replace(text, "`[^`]+`", " ")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-zA-Z][a-zA-Z0-9_-]{2,})\b"), 1)
    return F.filter(words, lambda w: ~w.isin(*V.KEYWORD_STOPWORDS))


def code_blocks(content: Column) -> Column:
    """T4: fenced blocks as an array of (language, code)."""
    whole = F.regexp_extract_all(content, F.lit("(?s)```(\\w*)\\n(.*?)```"), 0)
    return F.transform(whole, lambda b: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(b, "^```(\\w*)", 1), F.lit("")), F.lit("unknown")).alias("language"),
        strip(F.regexp_extract(b, "(?s)^```\\w*\\n(.*?)```$", 1)).alias("code"),
    ))


def goal(c: Column) -> Column:
    """Goal with most keyword hits, the earlier goal on a tie."""
    lowered = F.lower(c)
    scores = []
    for place, (name, words) in enumerate(V.GOAL_KEYWORDS):
        hits = sum((lowered.contains(w.lower()).cast("int") for w in words), F.lit(0))
        scores.append(F.struct(hits.alias("hits"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best["hits"] > 0, best["name"]).otherwise(V.DEFAULT_GOAL)


def phase(goal_name: Column) -> Column:
    out = F
    for name, value in V.PHASE_BY_GOAL.items():
        out = out.when(goal_name == name, value)
    return out.otherwise(V.DEFAULT_PHASE)


def apply_to(front: Column, description: Column) -> Column:
    """Declared globs, else those in the description, else everything."""
    def value(raw: Column) -> Column:
        return F.nullif(F.regexp_replace(strip(raw), "^['\"]+|['\"]+$", ""), F.lit(""))

    declared = value(F.regexp_extract(front, r"(?m)^\s*applyTo:(.*)$", 1))
    described = value(F.regexp_extract(description, r"Triggers on:\s*(.+)$", 1))
    return F.coalesce(declared, described, F.lit("**/*"))

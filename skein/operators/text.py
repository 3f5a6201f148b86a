"""Lines, fences, headings, sections and the decomposition of documents.

A document is one row, so what belongs to one document never outgrows a row. The line
array of a document is cut at its fences and headings before it is exploded, so each
line knows its place in one pass and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import text_values as V

FENCE = "^\\s*```"
HEADING = "^(#{1,4})\\s+(.+)$"


def explode_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """S3: one row per line, numbered from 1, empty lines kept."""
    keep = [c for c in documents.columns if c != text]
    return documents.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).cast("long").alias("line_no"), "line"
    )


def _positions(lines: Column, pattern: str) -> Column:
    """0-based places of the lines that match."""
    places = F.transform(lines, lambda line, i: F.when(line.rlike(pattern), i))
    return F.filter(places, lambda i: i.isNotNull())


def _cut(lines: Column, at: Column) -> Column:
    """Runs of lines, the first up to the first place, each other from a place on."""
    none = F.array().cast("array<int>")
    starts = F.concat(F.array(F.lit(0)), F.coalesce(at, none))
    ends = F.concat(F.coalesce(at, none), F.array(F.size(lines)))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r, i: F.struct(
        i.alias("run"), r["s"].alias("start"), F.slice(lines, r["s"] + 1, r["e"] - r["s"]).alias("lines")))


def lines_with_context(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each line with its fence state, code language and section heading.

    ``in_code`` covers the fence lines themselves; an open fence runs to the end.
    Headings inside code do not count. ``key`` names the document.
    """
    keep = [c for c in documents.columns if c != text]
    fences = F.when(F.col(text).contains("```"), _positions(F.col("__lines"), FENCE))
    runs = documents.withColumn("__lines", F.split(text, "\n", -1)).withColumn("__runs", _cut(F.col("__lines"), fences))

    # Runs with an odd number are code. The heading in force before a run is the last one
    # of the prose runs before it.
    last = F.transform("__runs", lambda r: F.when(
        r["run"] % 2 == 0, F.try_element_at(F.filter(r["lines"], lambda line: line.rlike(HEADING)), F.lit(-1))))
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<string>").alias("before"))
    heads = F.aggregate(last, start, lambda acc, h: F.struct(
        F.coalesce(h, acc["now"]).alias("now"), F.concat(acc["before"], F.array(acc["now"])).alias("before")))["before"]
    no_heads = F.transform("__runs", lambda r: F.lit(None).cast("string"))
    opener = F.transform("__runs", lambda r, i: F.regexp_extract(
        F.get(F.when(i % 2 == 1, r["lines"]).otherwise(F.get("__runs", i - 1)["lines"]), F.lit(0)), "^\\s*```(\\w*)", 1))
    runs = runs.withColumn("__heads", F.when(F.col(text).contains("#"), heads).otherwise(no_heads)).withColumn("__open", opener)
    one = runs.select(*keep, F.explode(F.arrays_zip("__runs", "__heads", "__open")).alias("z"))
    one = one.select(*keep, "z.__runs.run", "z.__runs.start", "z.__runs.lines", F.col("z.__heads").alias("head"), F.col("z.__open").alias("opened"))

    # Prose runs are cut again at their headings.
    prose = F.when(F.col("run") % 2 == 0, _positions(F.col("lines"), HEADING))
    sections = one.select(*keep, "run", "start", "head", "opened", F.explode(_cut(F.col("lines"), prose)).alias("p"))
    heading = F.when(F.col("p.run") > 0, F.get("p.lines", F.lit(0))).otherwise(F.col("head"))
    lines = sections.select(
        *keep, "run", (F.col("start") + F.col("p.start")).alias("first"), F.col("p.run").alias("part"), heading.alias("head"), "opened",
        F.posexplode("p.lines").alias("pos", "line"))
    is_fence = (F.col("run") > 0) & (F.col("part") == 0) & (F.col("pos") == 0)
    in_code = (F.col("run") % 2 == 1) | is_fence
    return lines.select(
        *keep,
        (F.col("first") + F.col("pos") + 1).cast("long").alias("line_no"),
        "line",
        is_fence.alias("is_fence"),
        in_code.alias("in_code"),
        F.when(in_code, F.col("opened")).alias("code_language"),
        F.coalesce(F.length(F.regexp_extract("head", HEADING, 1)), F.lit(0)).cast("long").alias("heading_level"),
        F.coalesce(X.strip(F.regexp_extract("head", HEADING, 2)), F.lit("")).alias("heading"),
    )


def headings(documents: DataFrame) -> DataFrame:
    """Headings of six levels, as (level, text) per line."""
    line = X.strip(F.col("line"))
    pattern = r"^(#{1,6})\s+(.+)$"
    found = explode_lines(documents).withColumn("line", line).where(F.col("line").rlike(pattern))
    return found.withColumn("level", F.length(F.regexp_extract("line", pattern, 1)).cast("long")).withColumn(
        "heading", X.strip(F.regexp_extract("line", pattern, 2))
    ).drop("line")


BULLET = "^(- |\\* |• )"


def item_text() -> Column:
    """A line without white space around it and without its bullet."""
    text = X.strip(F.col("line"))
    return F.when(~F.col("in_code") & text.rlike(BULLET), F.regexp_replace(text, "^[-*•]\\s+", "")).otherwise(text)


def is_item() -> Column:
    """A list item or paragraph outside code that is long enough and no command; needs ``item``."""
    bullet = X.strip(F.col("line")).rlike(BULLET)
    long_enough = F.when(bullet, F.length("item") > 10).otherwise(F.length("item") > 30)
    return ~F.col("in_code") & ~F.col("line").rlike(HEADING) & long_enough & ~X.is_command(F.col("item"))


def section_items(lines: DataFrame) -> DataFrame:
    """List items and paragraphs that are long enough and no commands."""
    return X.computed_once(lines, item=item_text()).where(is_item())


def code_commands(lines: DataFrame) -> DataFrame:
    """Command lines inside fences."""
    text = X.strip(F.col("line"))
    return lines.where(F.col("in_code") & ~F.col("is_fence")).withColumn("command", text).where(
        (F.col("command") != "") & X.is_command(F.col("command"))
    )


def item_kind() -> Column:
    """Rule, action or directive by precedence, null for the rest; needs ``clean`` and ``heading``."""
    clean = F.col("clean")
    in_directives = (F.col("heading") != "") & X.contains_any(F.lower("heading"), V.DIRECTIVE_HEADING_KEYWORDS)
    return (
        F.when(X.is_rule_sentence(clean) & ~in_directives, "rule")
        .when(X.is_action_sentence(clean) & ~in_directives, "action")
        .when(in_directives | (F.length(clean) > 50), "directive")
    )


def classified_items(items: DataFrame) -> DataFrame:
    """Items with their kind; others go."""
    clean = X.computed_once(items, clean=X.clean_markup(F.col("item"))).where(F.length("clean") >= 15)
    return X.computed_once(clean, kind=item_kind()).where(F.col("kind").isNotNull())


def cut(text: Column, length: int | None) -> Column:
    return text if length is None else F.substring(text, 1, length)


def keep_first(df: DataFrame, keys: list[str], text: Column, order: list, start: int | None = None) -> DataFrame:
    """The first row per lower-case text, or per start of it if a length is given."""
    w = Window.partitionBy(*keys, "__start").orderBy(*order)
    return (
        df.withColumn("__start", F.lower(cut(text, start))).withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") == 1).drop("__rn", "__start")
    )


def element_ids(df: DataFrame, keys: list[str], order: list, kinds: dict[str, int] | None = None) -> DataFrame:
    """a_001, r_001, d_001 .. by place; ``kinds`` may set how many of a kind stay."""
    w = Window.partitionBy(*keys, "kind").orderBy(*order)
    ranked = df.withColumn("__rn", F.row_number().over(w))
    for kind, n in (kinds or {}).items():
        ranked = ranked.where((F.col("kind") != kind) | (F.col("__rn") <= n))
    return ranked.withColumn("element_id", F.format_string("%s_%03d", F.substring("kind", 1, 1), F.col("__rn"))).drop("__rn")


def decompose(documents: DataFrame, key: str, limits: V.Limits | None = None) -> DataFrame:
    """Typed elements of each document, as rows.

    Commands come before the items of the sections. Every element is given, with its
    whole texts, unless ``limits`` are passed.
    """
    most = limits or V.Limits({}, None, None, None, None, None, None)
    body = documents.select(key, X.body_text(F.col("text")).alias("text"))
    lines = X.computed_once(lines_with_context(body, key), item=item_text())
    command = F.col("in_code") & ~F.col("is_fence") & X.is_command(F.col("item"))
    picked = X.computed_once(lines, command=command).where(F.col("command") | is_item())
    clean = F.col("clean")
    kinds = X.computed_once(picked, clean=F.when(F.col("command"), F.col("item")).otherwise(X.clean_markup(F.col("item"))))
    kinds = X.computed_once(kinds, kind=F.when(F.col("command"), "action").when(F.length("clean") >= 15, item_kind()))
    kind = F.col("kind")
    found = kinds.where(kind.isNotNull()).select(
        key, "line_no", F.when(F.col("command"), 0).otherwise(1).alias("part"), "kind",
        F.when(F.col("command"), F.concat(F.lit("Run "), F.regexp_extract("item", r"^(\S+)", 1)))
        .when(kind == "action", cut(clean, most.action_name)).otherwise(cut(clean, most.text)).alias("name"),
        F.when(F.col("command"), cut(clean, most.command)).otherwise(cut(clean, most.text)).alias("description"),
        F.when(F.col("command"), "external_call").when(kind == "action", X.action_type(clean))
        .when(kind == "directive", X.directive_type(clean)).alias("element_type"),
        F.when(kind == "rule", F.when(F.col("heading") != "", cut(F.lower("heading"), most.condition)).otherwise("general")).alias("condition"),
    )
    # One shuffle by document serves all windows.
    order = ["part", "line_no"]
    found = found.repartition(F.col(key))
    if most.commands is not None:
        place = Window.partitionBy(key, "part").orderBy("line_no")
        found = found.withColumn("__rn", F.row_number().over(place)).where((F.col("part") == 1) | (F.col("__rn") <= most.commands)).drop("__rn")
    found = keep_first(found, [key, "kind"], F.col("name"), order, most.start)
    return element_ids(found, [key], order, most.kinds).select(
        key, "kind", "element_id", "line_no", "name", "description", "element_type", "condition"
    )


def decomposed_documents(documents: DataFrame, key: str) -> DataFrame:
    """One nested row per document, with the elements of that document."""
    def part(kind: str, *fields) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("element_id").alias("id"), *fields))))

    elements = decompose(documents, key).groupBy(key).agg(
        part("action", "name", F.col("element_type").alias("action_type"), "description",
             F.lit(True).alias("deterministic")).alias("actions"),
        part("rule", F.col("condition").alias("condition_expression"), "description").alias("rules"),
        part("directive", F.col("element_type").alias("directive_type"), "description",
             F.lit(False).alias("decomposable")).alias("directives"),
    )
    meta = documents.select(key, X.frontmatter(F.col("text")).alias("meta"))
    return meta.join(elements, key, "left")


def references(documents: DataFrame, key: str) -> DataFrame:
    """Distinct relative paths a document names in links, inline code and frontmatter."""
    content = F.col("text")
    body = X.body_text(content)
    links = F.regexp_extract_all(body, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), 1)
    inline = F.regexp_extract_all(F.regexp_replace(body, "(?s)```.*?```", ""), F.lit("`([^`\n]+)`"), 1)
    fields = F.map_values(X.frontmatter(content))
    every = F.transform(F.concat(links, inline, fields), X.strip)
    paths = F.array_distinct(F.filter(every, X.is_relative_path))
    return documents.select(key, F.posexplode(paths).alias("pos", "path")).select(
        key, (F.col("pos") + 1).cast("long").alias("place"), "path", X.file_kind(F.col("path")).alias("file_kind")
    )


def resolved_references(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """References against the files present."""
    have = inventory.select("path").distinct().withColumn("__here", F.lit(True))
    return refs.join(have, "path", "left").withColumn("resolved", F.coalesce("__here", F.lit(False))).drop("__here")


def command_references(documents: DataFrame, key: str) -> DataFrame:
    """Commands with shell family, authority and risk."""
    body = documents.select(key, X.body_text(F.col("text")).alias("text"))
    found = code_commands(lines_with_context(body, key))
    command = F.col("command")
    return found.select(
        key, "line_no", "command", X.shell_family(command).alias("shell_family"), X.authority(command).alias("authority_profile")
    ).withColumn("risk_grade", X.command_risk(command, F.col("authority_profile")))


def delegations(documents: DataFrame, key: str) -> DataFrame:
    """Forked context, named agent and delegation words."""
    meta = X.frontmatter(F.col("text"))
    agent = X.strip(F.coalesce(F.try_element_at(meta, F.lit("agent")), F.lit("")))
    context = F.lower(X.strip(F.coalesce(F.try_element_at(meta, F.lit("context")), F.lit(""))))
    words = X.body_text(F.col("text")).rlike(r"(?i)\b(subagent|delegate|delegation)\b")
    named = F.nullif(agent, F.lit(""))
    node = F.array_compact(F.array(
        F.when(context == "fork", F.struct(F.lit("fork_context").alias("signal"), F.lit(None).cast("string").alias("agent"))),
        F.when(agent != "", F.struct(F.lit("named_agent").alias("signal"), named.alias("agent"))),
        F.when(words, F.struct(F.lit("subagent_reference").alias("signal"), named.alias("agent"))),
    ))
    return documents.select(key, F.explode(node).alias("node")).select(key, "node.signal", "node.agent")


def analysis_findings(refs: DataFrame, commands: DataFrame, signals: DataFrame, key: str, command_length: int | None = None) -> DataFrame:
    """Findings of four kinds per document; commands are named in full unless a length is given."""
    def finding(df: DataFrame, title: Column, category: str, severity: Column, confidence: str, advice: str) -> DataFrame:
        return df.select(
            key, title.alias("title"), F.lit(category).alias("category"), severity.alias("severity"),
            F.lit(confidence).alias("confidence"), F.lit(advice).alias("recommended_action"),
        )

    medium = F.lit("medium")
    missing = finding(
        refs.where(~F.col("resolved")), F.concat(F.lit("Unresolved reference: "), F.col("path")),
        "reference_integrity", medium, "high", "resolve_reference",
    )
    risky = finding(
        commands.where(F.col("risk_grade").isin("medium", "high")),
        F.concat(F.lit("Authority-bearing command: "), cut(F.col("command"), command_length)),
        "execution_authority", F.col("risk_grade"), "high", "review_before_run",
    )
    delegated = finding(
        signals.select(key).distinct(), F.lit("Delegation path present"), "control_flow", F.lit("info"), "high", "confirm_scope",
    )
    hidden = finding(
        refs.groupBy(key).agg(F.bool_or("resolved").alias("some")).where(~F.col("some")),
        F.lit("All supporting references are unresolved"), "hidden_dependency", medium, "medium", "document_dependency",
    )
    return missing.unionByName(risky).unionByName(delegated).unionByName(hidden)


def manifest_rollup(documents: DataFrame, refs: DataFrame, commands: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """Supporting files, commands, delegations and unresolved references per document."""
    r = refs.groupBy(key).agg(F.count(F.lit(1)).alias("supporting_files"), F.count_if(~F.col("resolved")).alias("unresolved"))
    c = commands.groupBy(key).agg(F.count(F.lit(1)).alias("commands"))
    s = signals.groupBy(key).agg(F.count(F.lit(1)).alias("delegations"))
    return (
        documents.select(key).join(r, key, "left").join(c, key, "left").join(s, key, "left")
        .fillna(0, ["supporting_files", "unresolved", "commands", "delegations"])
    )

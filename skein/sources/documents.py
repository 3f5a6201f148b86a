"""Readers of document folders and writers of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S = T.StringType()
ACTION = _struct(id=_S, name=_S, action_type=_S, description=_S, deterministic=T.BooleanType(),
                 immutable_elements=_TEXTS, mutable_elements=_TEXTS, side_effects=_TEXTS)
RULE = _struct(id=_S, name=_S, condition_type=_S, condition_expression=_S, returns=_S, description=_S,
               fail_action=_S, branching_targets=_TEXTS)
DIRECTIVE = _struct(id=_S, name=_S, directive_type=_S, description=_S, decomposable=T.BooleanType(),
                    decomposition_hint=_S, related_elements=_TEXTS)
PATH = _struct(path_id=T.IntegerType(), path_name=_S, sequence=_TEXTS, condition=_S, description=_S, expected_outcome=_S)
META = _struct(skill_id=_S, name=_S, skill_layer=_S, title=_S, description=_S, schema_version=_S,
               parse_timestamp=_S, parser_version=_S, parsed_by=_S)
DOCUMENT = _struct(
    meta=META,
    original_definition=_struct(source=_S, skill_name=_S, skill_description=_S),
    decomposition=_struct(actions=T.ArrayType(ACTION), rules=T.ArrayType(RULE), directives=T.ArrayType(DIRECTIVE)),
    execution_paths=T.ArrayType(PATH),
)
CORRUPT = "_corrupt_record"


class SnapshotError(ValueError):
    """A strict read met files that are no documents; ``files`` has the name of each."""

    def __init__(self, count: int, files: DataFrame):
        super().__init__(f"{count} files are no documents, the first is {files.first()['filename']}")
        self.count, self.files = count, files


def read_documents(spark: SparkSession, folder: str, strict: bool = False, multiline: bool = True) -> DataFrame:
    """JSON documents with their file name.

    The tolerant reader leaves out what does not parse; the strict one rejects the whole
    folder with an error that names every such file.
    """
    schema = T.StructType([*DOCUMENT.fields, T.StructField(CORRUPT, T.StringType())])
    docs = (
        spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.json").json(folder)
        .withColumn("filename", F.col("_metadata.file_name"))
    )
    bad = F.col(CORRUPT).isNotNull() | F.col("meta").isNull()
    if strict:
        files = docs.where(bad).select("filename").distinct().orderBy("filename")
        if count := files.count():
            raise SnapshotError(count, files)
    return docs.where(~bad).drop(CORRUPT)


def read_text_corpus(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt", "yaml", "yml")) -> DataFrame:
    """Whole text files below a folder; the unit is the directory of the file."""
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .text(folder, wholetext=True)
        .select(
            F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("unit"), path.alias("path"),
            F.regexp_extract(path, r"\.([^.]+)$", 1).alias("ext"), F.col("value").alias("text"),
        )
    )


def file_digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """SHA-256, size and time of each file. For document files; one file is one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(
        "path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def write_report(patterns: DataFrame, path: str, examples: int = 3) -> None:
    """Patterns by falling frequency, rounded to 3 places, with few examples."""
    out = patterns.withColumn("frequency", F.round("frequency", 3))
    if "examples" in patterns.columns:
        out = out.withColumn("examples", F.slice("examples", 1, examples))
    out.orderBy(F.desc("frequency"), "pattern_id").write.json(path)


def scan_reports(units: DataFrame, findings: DataFrame, page: int = 1000) -> DataFrame:
    """Report text of each unit: a header document, then pages of its findings.

    A unit may have any number of findings, so they come in pages of bounded size.
    """
    header = units.select(
        "unit", F.lit(0).cast("long").alias("page"),
        F.to_json(F.struct("unit", "risk_level", "risk_score", "files_scanned", "findings")).alias("report"),
    )
    fields = ["path", "line_no", "rule_id", "pattern_idx", "severity"]
    cell = F.pmod(F.xxhash64("path", "line_no", "rule_id", "pattern_idx"), F.greatest(F.lit(1), F.ceil(F.col("findings") / page)).cast("long"))
    pages = (
        findings.join(units.select("unit", "findings"), "unit").withColumn("page", cell + 1)
        .groupBy("unit", "page").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("report"))
    )
    return header.unionByName(pages)

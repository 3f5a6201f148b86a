"""Stateful streams over split files, with rows out of order, late and repeated, against a plain walk over what is in time."""

import datetime as dt
import random
import tempfile

import pytest

from skein.functions import ledger_values as V
from skein.streaming import late, stateful
from skein.streaming import ledger as G

@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Every partition has a state store and a worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "event_id long, run_id string, event_type string, occurred_at timestamp"
START = dt.datetime(2024, 3, 1)
HOUR = 3600


def batches_of(kinds, seed):
    """Files of events that come up to 40 minutes out of order; the last files repeat events and bring some that are days late."""
    rnd = random.Random(seed)
    rows = [(i, f"r{rnd.randrange(12)}", rnd.choice(kinds), i * 600 + rnd.randrange(2400)) for i in range(500)]
    files = [rows[at : at + 100] for at in range(0, 500, 100)]
    files[3] = files[3] + rnd.sample(rows[:100], 10)
    files[4] = files[4] + rows[400:410]
    return files


def files_of(spark, files):
    folder = tempfile.mkdtemp(prefix="skein-stateful-") + "/in"
    for rows in files:
        whole = [(i, run, kind, START + dt.timedelta(seconds=at)) for i, run, kind, at in rows]
        spark.createDataFrame(whole, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def in_time(files, delay):
    """What Spark does not drop, and the last watermark."""
    kept, mark = [], -1
    for rows in files:
        kept += [r for r in rows if r[3] > mark]
        mark = max(mark, max(r[3] for r in rows) - delay)
    return kept, mark


def plain_approvals(files, ttl, delay):
    kept, mark = in_time(files, delay)
    out = []
    for key in sorted({r[1] for r in kept}):
        item = None
        for i, _, kind, at in sorted((r for r in kept if r[1] == key and r[3] <= mark), key=lambda r: (r[3], r[0], r[2])):
            if item and item[1] <= at:
                out.append((item[0], "expired"))
                item = None
            if kind == "approval_required":
                item = item or (i, at + ttl)
            elif item:
                out.append((item[0], kind))
                item = None
        if item and item[1] <= mark:
            out.append((item[0], "expired"))
    return sorted(out)


@pytest.mark.parametrize("ttl", [2 * HOUR, 12 * HOUR])
def test_approvals(spark, ttl):
    files = batches_of(["approval_required", "approval_granted", "approval_rejected"], 4)
    stream = files_of(spark, files)
    got = G.as_table(stateful.approvals(stream, ["run_id"], "event_id", "approval_required", ttl), "t", None, "append").collect()
    want = plain_approvals(files, ttl, HOUR)
    assert sorted((r.item_id, r.outcome) for r in got) == want
    assert {o for _, o in want} == {"approval_granted", "approval_rejected", *(["expired"] if ttl == 2 * HOUR else [])}


def test_a_decision_at_the_end_is_too_late(spark):
    files = [[(1, "a", "approval_required", 0), (2, "a", "approval_granted", HOUR), (3, "b", "approval_required", 0), (4, "b", "approval_granted", HOUR - 1)],
             [(5, "z", "approval_granted", 10 * HOUR)]]
    got = G.as_table(stateful.approvals(files_of(spark, files), ["run_id"], "event_id", "approval_required", HOUR), "t", None, "append")
    assert sorted((r.item_id, r.outcome) for r in got.collect()) == [(1, "expired"), (3, "approval_granted")]


def test_one_batch_is_as_many(spark):
    files = batches_of(["approval_required", "approval_granted"], 8)[:3]
    one = [sum(files, [])]
    runs = [G.as_table(stateful.approvals(files_of(spark, f), ["run_id"], "event_id", "approval_required", HOUR), "t", None, "append") for f in (files, one)]
    assert sorted(map(tuple, runs[0].collect())) == sorted(map(tuple, runs[1].collect()))


def plain_violations(files, delay, keep):
    kept, mark = in_time(files, delay)
    out = []
    for key in sorted({r[1] for r in kept}):
        final = outcome = False
        last = None
        for i, _, kind, at in sorted((r for r in kept if r[1] == key and r[3] <= mark), key=lambda r: (r[3], r[0], r[2])):
            if last is not None and last + keep <= at:
                final = outcome = False
            if final:
                out.append((key, i, "after_final_terminal"))
            elif outcome and kind not in V.ALLOWED_AFTER_OUTCOME:
                out.append((key, i, "invalid_after_outcome"))
            final, outcome, last = final or kind in V.FINAL_EVENTS, outcome or kind in V.OUTCOME_EVENTS, at
    return sorted(out)


@pytest.mark.parametrize("keep", [HOUR, 24 * HOUR])
def test_violations(spark, keep):
    files = batches_of(["run_created", "action_started", "run_succeeded", "run_failed", "run_cancelled", "compensation_queued"], 6)
    got = G.as_table(stateful.violations(files_of(spark, files), keep_seconds=keep), "t", None, "append").collect()
    want = plain_violations(files, HOUR, keep)
    assert sorted((r.run_id, r.event_id, r.violation) for r in got) == want
    assert {v for *_, v in want} == {"after_final_terminal", "invalid_after_outcome"}


def test_finished_keys_leave_no_state(spark):
    files = [[(1, "a", "approval_required", 0), (2, "b", "approval_required", 0), (3, "b", "approval_granted", 60)], [(4, "z", "approval_granted", 50 * HOUR)],
             [(5, "z", "approval_granted", 90 * HOUR)]]
    stream = stateful.approvals(files_of(spark, files), ["run_id"], "event_id", "approval_required", HOUR)
    query = G.write_batches(stream, tempfile.mkdtemp(prefix="skein-state-"), "append")
    # Only the last event, which the watermark has not passed, still waits; keys are counted per state variable.
    counted = query.recentProgress[-1]["stateOperators"][0]
    assert counted["numRowsTotal"] <= 2


def test_late_rows_are_told_apart(spark):
    files = [[(1, "a", "x", 0), (2, "a", "x", 20 * HOUR)], [(3, "a", "x", HOUR), (4, "a", "x", 19 * HOUR + 5), (5, "a", "x", 18 * HOUR + 5)], [(6, "a", "x", 30 * HOUR), (7, "a", "x", 0)]]
    stream = files_of(spark, files)
    folder = tempfile.mkdtemp(prefix="skein-late-")
    late.split_late(stream, folder, "occurred_at", HOUR, HOUR)
    ids = {kind: sorted(r.event_id for r in late.rows_of(spark, folder, stream.schema, kind).collect()) for kind in (True, False)}
    assert ids == {True: [3, 5, 7], False: [1, 2, 4, 6]}
    assert sorted((r.rows, r.late) for r in late.marks(spark, folder).collect()) == [(2, 0), (2, 1), (3, 2)]

"""Every registered query against its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def test_names_match():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    relation = con.execute(ORACLES[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, rows) == table(columns, relation.fetchall())


OUTCOMES = {
    "g5_approval_outcomes": ("outcome", {"approval_granted", "approval_rejected", "expired"}),
    "x1_custom_rule_pack": ("rule_id", {"LIC1", "PII1", "PII2"}),
    "a25_release_gates": ("complete_corpus", {True}),
    "j18_judged_rankings": ("hit", {True, False}),
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_every_outcome_occurs(spark, name):
    """A check that can only go one way proves nothing."""
    column, values = OUTCOMES[name]
    folder = os.path.join(os.path.dirname(SF), "sf0.01")
    found = {r[column] for r in entry.queries()[name](spark, folder if os.path.isdir(folder) else SF).collect()}
    assert found >= values


def test_entry(spark):
    assert entry.entry(spark).count() > 0

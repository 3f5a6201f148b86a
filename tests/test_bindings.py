"""Contract problems of action bindings."""

from skein.operators import documents as N

SHAPE = "doc_id long, action_id string, role string, compensation_id string"
ROWS = [
    (1, "a", "primary", "b"), (1, "b", "compensation", None), (1, "c", "compensation", ""), (1, "d", "primary", "x"), (1, "e", "primary", "a"),
    (2, "a", "primary", "a"), (2, "a", "primary", "a"), (2, "b", "other", None), (2, "b", "compensation", "a"), (2, "c", None, "c"), (2, "c", None, "b"),
    (None, "a", "primary", "b"), (None, "b", "compensation", None), (3, None, "compensation", "a"), (3, "a", "primary", None),
]
PROBLEMS = {
    (1, "c", "orphan_compensation"), (1, "d", "target_has_no_binding"), (1, "e", "target_role_is_not_compensation"),
    (2, "a", "duplicate_binding"), (2, "a", "compensates_itself"), (2, "a", "target_role_is_not_compensation"),
    (2, "b", "duplicate_binding"), (2, "b", "invalid_role"), (2, "b", "target_role_is_not_compensation"),
    (2, "c", "duplicate_binding"), (2, "c", "invalid_role"), (2, "c", "compensates_itself"), (2, "c", "target_has_no_binding"),
    (None, "a", "target_has_no_binding"), (None, "b", "orphan_compensation"), (3, None, "orphan_compensation"), (3, None, "target_role_is_not_compensation"),
}


def test_every_problem_once_and_the_input_read_once(spark, tmp_path):
    path = str(tmp_path / "bindings")
    spark.createDataFrame(ROWS, SHAPE).write.parquet(path)
    found = N.binding_problems(spark.read.parquet(path))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == PROBLEMS
    assert path not in found._jdf.queryExecution().executedPlan().toString()

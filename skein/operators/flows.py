"""What documents do in which order, from their execution flows.

A flow is a table of steps with an element each and the steps they may go on to, so it may branch, join and loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds by the first letters of an element reference (fixed values).
KINDS = {"a_": "action", "r_": "rule", "d_": "directive"}


def walk(steps: list[dict]) -> list[str]:
    """Kinds of the steps of one flow, each step once, depth first.

    Walks begin at the steps that no other one goes on to, by position, then at steps of loops not met yet. A step goes on to
    its targets in their order; unknown targets and references of no kind are passed over.
    """
    by_name = {s["step"]: s for s in steps}
    in_order = sorted(by_name.values(), key=lambda s: (s["position"], s["step"]))
    reached = {t for s in in_order for t in s["targets"] or () if t != s["step"]}
    met, kinds = set(), []
    open_ = [s["step"] for s in reversed(in_order)] + [s["step"] for s in reversed(in_order) if s["step"] not in reached]
    while open_:
        name = open_.pop()
        if name in met or name not in by_name:
            continue
        met.add(name)
        kind = KINDS.get((by_name[name]["element_ref"] or "")[:2])
        if kind:
            kinds.append(kind)
        open_ += reversed(by_name[name]["targets"] or ())
    return kinds


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = [walk(steps) for steps in batch.column("steps").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "sequence"])


def flow_sequences(steps: DataFrame) -> DataFrame:
    """(doc_id, sequence) of every flow with a step of a kind. Columns: doc_id, step, position, element_ref, targets.

    A flow is one document's, so it fits its row. Rows without a step go; of rows with one step name the last by position counts,
    then by reference and targets.
    """
    row = F.struct("position", "element_ref", "targets")
    one = steps.where(F.col("step").isNotNull()).groupBy("doc_id", "step").agg(F.max(row).alias("s"))
    flows = one.groupBy("doc_id").agg(F.collect_list(F.struct("step", F.coalesce("s.position", F.lit(0)).alias("position"), "s.element_ref", "s.targets")).alias("steps"))
    kind = steps.schema["doc_id"].dataType.simpleString()
    return flows.mapInArrow(_walked, f"doc_id {kind}, sequence array<string>").where(F.size("sequence") > 0)


def frequent_patterns(sequences: DataFrame, support: float = 0.1, longest: int = 5) -> DataFrame:
    """(pattern, length, documents): orders of kinds, with gaps, that at least this share of the sequences has (PrefixSpan)."""
    items = sequences.select(F.transform("sequence", lambda x: F.array(x)).alias("sequence"))
    found = PrefixSpan(minSupport=support, maxPatternLength=longest).findFrequentSequentialPatterns(items)
    return found.select(
        F.array_join(F.flatten("sequence"), "->").alias("pattern"), F.size("sequence").cast("long").alias("length"), F.col("freq").alias("documents"))

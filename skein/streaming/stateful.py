"""Stateful operators on the event log: rows wait in state until the watermark has passed them and are then taken in order.

Built on ``transformWithState`` with event-time timers. State lives per key, every timer stands at the next moment at which something can
happen, and keys whose work is done leave no state behind. Rows that come after the watermark are dropped by Spark; ``late.split_late`` counts and keeps them.
A key's rows are one sequence by nature, so a key is one task's work; what waits is only what came within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from skein.functions import ledger_values as V

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "at long, ident long, kind string"


def _ms(micros: int) -> int:
    """The first millisecond that is not before the moment."""
    return -(-micros // 1000)


class Ordered(StatefulProcessor):
    """Takes the rows of a key in order of (at, ident) once the watermark has passed them.

    Subclasses keep ``facts``, a tuple of the fields of ``FACTS`` or None, and say what an event and the passing of time do to it.
    """

    FACTS = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.facts = handle.getValueState("facts", self.FACTS)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at, r.ident, r.kind) for r in rows]
        self.waiting.appendList(new)
        # The earliest of these rows may come before the timer that is set; a timer too many does nothing.
        self.handle.registerTimer(_ms(min(at for at, _, _ in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= passed]
        before = facts = tuple(self.facts.get()) if self.facts.exists() else None
        out: list[Row] = []
        for at, ident, kind in due:
            facts = self.elapse(key, facts, at, out)
            facts = self.take(key, facts, at, ident, kind, out)
        facts = self.elapse(key, facts, passed, out)
        rest = waiting[len(due):]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if facts != before:
            self.facts.update(facts) if facts is not None else self.facts.clear()
        next_at = [rest[0][0]] if rest else []
        if facts is not None:
            next_at.append(self.deadline(facts))
        if next_at:
            self.handle.registerTimer(_ms(min(next_at)))
        return iter(out)

    def take(self, key, facts, at: int, ident: int, kind: str, out: list[Row]):
        raise NotImplementedError

    def elapse(self, key, facts, now: int, out: list[Row]):
        """The facts after all deadlines up to ``now``, which is included."""
        raise NotImplementedError

    def deadline(self, facts) -> int:
        raise NotImplementedError


class Approvals(Ordered):
    """One open item per key: the first decision before its end settles it, else it expires at its end.

    Requests while an item is open are repeats; decisions without an open item change nothing.
    """

    FACTS = "item_id long, ends long"

    def __init__(self, request: str, ttl: int) -> None:
        self.request, self.ttl = request, ttl

    def take(self, key, facts, at, ident, kind, out):
        if kind == self.request:
            return facts or (ident, at + self.ttl)
        if facts:
            out.append(Row(item_id=facts[0], outcome=kind, settled_at=at))
        return None

    def elapse(self, key, facts, now, out):
        if facts and facts[1] <= now:
            out.append(Row(item_id=facts[0], outcome="expired", settled_at=facts[1]))
            return None
        return facts

    def deadline(self, facts) -> int:
        return facts[1]


class Legality(Ordered):
    """Events after the run's first final event, and events not allowed after its first outcome.

    A run is forgotten ``keep`` after its last event.
    """

    FACTS = "final boolean, outcome boolean, gone long"

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def take(self, key, facts, at, ident, kind, out):
        final, outcome, _ = facts or (False, False, 0)
        wrong = "after_final_terminal" if final else "invalid_after_outcome" if outcome and kind not in V.ALLOWED_AFTER_OUTCOME else None
        if wrong:
            out.append(Row(run_id=key[0], event_id=ident, event_type=kind, violation=wrong))
        return final or kind in V.FINAL_EVENTS, outcome or kind in V.OUTCOME_EVENTS, at + self.keep

    def elapse(self, key, facts, now, out):
        return None if facts and facts[2] <= now else facts

    def deadline(self, facts) -> int:
        return facts[2]


def _taken(events: DataFrame, keys: list[str], ident: str, delay: str, processor: Ordered, shape: str) -> DataFrame:
    """The processor over a stream of events with occurred_at and event_type; keys and ``ident`` must not be null."""
    at: Column = F.unix_micros("occurred_at")
    rows = events.withWatermark("occurred_at", delay).select(*keys, "occurred_at", at.alias("at"), F.col(ident).cast("long").alias("ident"), F.col("event_type").alias("kind"))
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    return rows.groupBy(*keys).transformWithState(processor, shape, "append", "EventTime")


def approvals(events: DataFrame, keys: list[str], ident: str, request: str, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """item_id, outcome, settled_at (microseconds) of every approval item, sent once, as soon as no earlier event can come.

    ``events`` are requests (their ``ident`` names the item) and decisions (their type is the outcome). A decision at an item's end or later is too late.
    """
    return _taken(events, keys, ident, delay, Approvals(request, ttl_seconds * 1_000_000), "item_id long, outcome string, settled_at long")


def violations(events: DataFrame, delay: str = "1 hour", keep_seconds: int = 86_400) -> DataFrame:
    """run_id, event_id, event_type, violation of every illegal event, in the stream itself; nothing is read again."""
    return _taken(events, ["run_id"], "event_id", delay, Legality(keep_seconds * 1_000_000), "run_id string, event_id long, event_type string, violation string")

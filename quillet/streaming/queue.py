"""A bounded job queue as a stateful stream: what waits is state by queue, each event gives its outcome.

Events are submissions and completions, (queue, event_id, ts, action, kind, target). A queue's state is the jobs that wait, by (kind, target), and their number; both are kept
in Spark's state store and its checkpoint, so a restarted stream goes on with them. Of one batch, a queue's events count in order of (ts, event_id).

- A submission is ``accepted``; it is a ``duplicate`` where the job waits already, or ``coalesced`` where its kind is one that must run again then; it is ``full``
  where ``room`` jobs wait.
- A completion is ``done`` and frees its place, or ``again`` where the job was coalesced meanwhile: it waits on, once. Without a waiting job it is ``unknown``.
- A job that waits longer than ``patience`` of event time is ``lost`` and frees its place, by a timer.

Events later than the watermark are dropped by Spark. A queue is one key: ``sharded`` spreads a large one over several, each with its share of the room.
The state store must be RocksDB's (``STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting that a session needs for this operator.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# Jobs that a queue holds; kinds of which a repeated submission makes one more run.
ROOM, RERUN = 64, ("fts",)
OUTCOMES = "queue string, event_id long, kind string, target string, outcome string"


class BoundedQueue(StatefulProcessor):
    def __init__(self, room: int = ROOM, rerun: tuple[str, ...] = RERUN, patience_ms: int = 3_600_000):
        self.room, self.rerun, self.patience = room, rerun, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "kind string, target string", "again boolean, since long")
        self.number = handle.getValueState("number", "n int")

    def _count(self) -> int:
        return self.number.get()[0] if self.number.exists() else 0

    def _one(self, e: Row, n: int) -> tuple[str, int]:
        job = (e["kind"], e["target"])
        waits = self.waiting.getValue(job) if self.waiting.containsKey(job) else None
        now = int(e["ts"].timestamp() * 1000)
        if e["action"] == "submit":
            if waits is not None:
                if e["kind"] not in self.rerun:
                    return "duplicate", n
                self.waiting.updateValue(job, (True, waits[1]))
                return "coalesced", n
            if n >= self.room:
                return "full", n
            self.waiting.updateValue(job, (False, now))
            self.handle.registerTimer(now + self.patience)
            return "accepted", n + 1
        if waits is None:
            return "unknown", n
        if waits[0]:
            self.waiting.updateValue(job, (False, now))
            self.handle.registerTimer(now + self.patience)
            return "again", n
        self.waiting.removeKey(job)
        return "done", n - 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self._count()
        for e in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            outcome, n = self._one(e, n)
            yield Row(queue=key[0], event_id=e["event_id"], kind=e["kind"], target=e["target"], outcome=outcome)
        self.number.update((n,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due, n = expiredTimerInfo.getExpiryTimeInMs() - self.patience, self._count()
        for job in [j for j, state in self.waiting.iterator() if state[1] <= due]:
            self.waiting.removeKey(job)
            n -= 1
            yield Row(queue=key[0], event_id=None, kind=job[0], target=job[1], outcome="lost")
        self.number.update((n,))

    def close(self) -> None:
        pass


def sharded(events: DataFrame, shards: int) -> DataFrame:
    """A queue's jobs dealt by kind and target to ``shards`` queues."""
    return events.withColumn("queue", F.concat_ws("/", "queue", F.pmod(F.xxhash64("kind", "target"), F.lit(shards))))


def outcomes(events: DataFrame, delay: str = "10 minutes", room: int = ROOM, rerun: tuple[str, ...] = RERUN, patience_ms: int = 3_600_000) -> DataFrame:
    """(queue, event_id, kind, target, outcome) of a stream of events."""
    keyed = events.withWatermark("ts", delay).groupBy("queue")
    return keyed.transformWithState(BoundedQueue(room, rerun, patience_ms), OUTCOMES, "Append", "EventTime")

"""Job queues as streams: coalescing by micro-batch, deduplication within a watermark, debounced sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesced(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """One job a key, the newest, with the number of requests that it stands for."""
    newest = F.max_by(F.struct(*[c for c in jobs.columns if c not in keys]), "event_id")
    out = jobs.groupBy(*keys).agg(newest.alias("j"), F.count(F.lit(1)).alias("requests"))
    return out.select(*keys, "j.*", "requests")


def run_coalesced(stream: DataFrame, keys: list[str], work: Callable[[DataFrame], None], checkpoint: str):
    """Works off what has arrived, batch by batch, each batch coalesced."""
    return stream.writeStream.foreachBatch(lambda batch, _: work(coalesced(batch, keys))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_once(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def debounced(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """One row a burst of events of a key less than ``gap`` apart: first and last time and their number."""
    out = events.groupBy(key, F.session_window(time, gap)).agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return out.drop("session_window")


class Full(RuntimeError):
    """A queue has no room."""


def offered(waiting: DataFrame, fresh: DataFrame, keys: list[str], room: int = 64) -> DataFrame:
    """A bounded queue after new jobs come: those whose key already waits are dropped, and more than ``room`` jobs are an error."""
    once = fresh.dropDuplicates(keys).join(waiting.select(*keys), keys, "left_anti")
    out = waiting.unionByName(once)
    if out.count() > room:
        raise Full(f"more than {room} jobs")
    return out


#: What follows when a job is done, in order.
CHAIN = {"ocr": ("ner", "fts", "embed"), "transcription": ("ner", "fts", "embed"), "ner": ("geocode",), "enrich": ("fts", "ner")}


def triggered(done: DataFrame) -> DataFrame:
    """The jobs that finished ones (kind, target, ...) set off: (step, kind, target)."""
    steps = F.create_map(*[x for k, v in CHAIN.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return done.where("status = 'complete'").select(F.posexplode(steps[F.col("kind")]).alias("step", "next"), "target").select("step", F.col("next").alias("kind"), "target")


def states(events: DataFrame, keys: list[str]) -> DataFrame:
    """The newest progress, completion or error of each job; of events at one time the later by number."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("s")).select(*keys, "s.*")


def enriched(batch: DataFrame, steps: dict[str, Callable[[DataFrame], None]]) -> dict[str, str | None]:
    """Runs steps one after another over a micro-batch; what one raises is its error, and the next runs all the same."""
    out: dict[str, str | None] = {}
    for name, step in steps.items():
        try:
            step(batch)
            out[name] = None
        except Exception as e:  # isolated by design: a step's failure is its result
            out[name] = f"{type(e).__name__}: {e}"
    return out


def run_serially(stream: DataFrame, steps: dict[str, Callable[[DataFrame], None]], checkpoint: str, tell: Callable[[int, dict], None]):
    """Works a stream off batch by batch, each step over the whole batch, and tells what came of it; the checkpoint makes it go on where it stopped."""

    def work(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            tell(number, enriched(batch, steps))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_request(requests: DataFrame, key: str, number: str) -> DataFrame:
    """Of requests that overtake each other only the newest counts."""
    rest = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.max_by(F.struct(*rest), number).alias("r")).select(key, "r.*")

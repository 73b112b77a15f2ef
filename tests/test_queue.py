"""The bounded queue as a stream: order, room, coalescing, restart, late events and lost jobs."""

import datetime

from quillet.streaming import queue

EVENT = "queue string, event_id long, ts timestamp, action string, kind string, target string"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def test_queue_goes_on_after_a_restart(spark, tmp_path):
    was = {k: spark.conf.get(k, None) for k in queue.STORE}
    for k, v in queue.STORE.items():
        spark.conf.set(k, v)
    try:
        seen = []

        def run(rows, batch):
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
            out = queue.outcomes(stream, "5 minutes", room=2, patience_ms=60 * 60_000)
            before = len(seen)
            sink = out.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp"))
            sink.trigger(availableNow=True).start().awaitTermination()
            return [(r[1], r[3], r[4]) for r in seen[before:]]

        first = [("q", 3, at(2), "submit", "fts", "a"), ("q", 1, at(0), "submit", "ner", "a"), ("q", 2, at(1), "submit", "ner", "a"), ("q", 4, at(3), "submit", "ner", "b"), ("p", 5, at(3), "submit", "ner", "b"), ("q", 6, at(4), "submit", "fts", "a")]
        assert sorted(run(first, 1)) == [(1, "a", "accepted"), (2, "a", "duplicate"), (3, "a", "accepted"), (4, "b", "full"), (5, "b", "accepted"), (6, "a", "coalesced")]
        second = [("q", 7, at(20), "done", "fts", "a"), ("q", 8, at(21), "done", "fts", "a"), ("q", 9, at(22), "submit", "ner", "b"), ("q", 10, at(23), "done", "ner", "z")]
        assert sorted(run(second, 2)) == [(7, "a", "again"), (8, "a", "done"), (9, "b", "accepted"), (10, "z", "unknown")]
        third = [("q", 11, at(1), "submit", "ner", "late"), ("q", 12, at(200), "submit", "ner", "c")]
        got = run(third, 3)
        assert (11, "late", "accepted") not in got and not any(g[0] == 11 for g in got)
        last = run([("q", 13, at(201), "submit", "ner", "d")], 4)
        outcome = {(t, o) for _, t, o in got + last}
        assert {("a", "lost"), ("b", "lost")} <= outcome  # ner a and b of q, b of p
        assert ("d", "accepted") in outcome
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

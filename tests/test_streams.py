"""Streams: state that expires, counters observed on the way, arrivals in several files."""

import datetime

from pyspark.sql import functions as F

from leadloom.streaming import jobs as J

START = datetime.datetime(2024, 1, 1)


def at(hours):
    return START + datetime.timedelta(hours=hours)


def test_expired_keys_leave_the_state_store(session, tmp_path):
    source, table, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    batches = [
        [(1, at(0), 1), (1, at(1), 2), (2, at(1), 3), (3, at(2), 4)],
        [(1, at(5.5), 5), (2, at(7), 6), (4, at(9), 7)],
        [(5, at(40), 8)],
        [(5, at(41), 9), (6, at(60), 10)],
        [(6, at(60.5), 11), (1, at(61), 12)],
    ]
    schema = "user bigint, ts timestamp, event bigint"
    session.createDataFrame([], schema).write.parquet(source)
    stream = session.readStream.schema(schema).parquet(source)
    due = J.due_fetches(stream, "user", ["event"], ttl_seconds=6 * 3600, lateness="10 minutes")
    held = []
    for rows in batches:
        session.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(source)
        J.write_log_table(due, table, progress, "append").awaitTermination()
        state = session.read.format("statestore").option("stateVarName", "value").load(progress)
        held.append(sorted(r.k for r in state.select(F.col("key.user").alias("k")).collect()))
    assert {r.event for r in J.read_log_table(session, table).collect()} == {1, 3, 4, 7, 8, 10, 12}  # the sixth comes right at the end of the TTL
    assert held[0] == [1, 2, 3]
    # long silence: the keys of the first day are gone, and so is the fifth in the end
    assert held[2] == [5] and set(held[4]) <= {1, 6} and 1 in held[4]


def test_observed_counters_equal_each_batch(session, tmp_path):
    source = str(tmp_path / "in")
    schema = "id bigint, failed boolean, from_cache boolean, bytes bigint"
    session.createDataFrame([], schema).write.parquet(source)
    parts = [session.range(n * 100, n * 100 + size).selectExpr("id", "id % 3 = 0 AS failed", "id % 7 = 0 AS from_cache", "id AS bytes")
             for n, size in enumerate((50, 1, 80))]
    live = J.LiveCounters()
    stream = J.counted(session.readStream.schema(schema).parquet(source))
    out = J.run_to_table(stream, "counters", counters=live, arrivals=[
        lambda p=p: p.repartition(4).write.mode("append").parquet(source) for p in parts])
    assert out.count() == 131
    want = [p.agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("failures"),
                  F.count_if("from_cache").alias("cache_hits"), F.sum("bytes").alias("bytes")).head().asDict() for p in parts]
    assert [{k: v for k, v in r.items() if k != "batch"} for r in live.rows] == want
    assert live.total()["requests"] == 131


def test_a_key_reads_its_state_once_and_writes_it_where_it_moves():
    from pyspark.sql import Row

    from leadloom.streaming.jobs import FetchGate, StrikeState

    class Store:
        def __init__(self, value):
            self.value, self.calls = value, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    def fed(processor, store, rows):
        processor.state = store
        return [tuple(r) for r in processor.handleInputRows((1,), iter(rows), None)]

    strikes = StrikeState(["ts", "id"], ["host", "ts", "id", "outcome", "strikes", "burned"], 3)
    rows = [Row(host=1, ts=t, id=i, outcome=o) for t, i, o in ((2, None, "strike"), (2, 1, "strike"), (1, 5, "reset"), (None, 3, None))]
    store = Store(None)
    assert fed(strikes, store, rows) == [(1, 1, 5, "reset", 0, False), (1, 2, 1, "strike", 1, False),
                                         (1, 2, None, "strike", 2, False), (1, None, 3, None, 2, False)]
    assert store.calls == ["get", "update"] and store.value == (2.0,)

    gate = FetchGate(["ts_us", "id"], ["host", "id", "ts_us"], 10)
    store = Store((0.0,))
    assert fed(gate, store, [Row(host=1, id=7, seen="x", ts_us=10_000_000)]) == [] and store.calls == ["get"]

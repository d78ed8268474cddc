"""Continuous forms of the operators: lead updates, cache gate, delays, strikes, rates.

Order-dependent state (delay, strikes, last fetch) lives per key in the state
store.  A micro-batch holds one trigger's input, so what a key brings at once
is bounded by the source's rate limit, never by its history.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import StructType

from .. import rules
from ..operators.contacts import FAMILIES, contacts_of
from ..operators.leads import best_contacts
from ..operators.logs import next_delay
from ..operators.upsert import latest_by
from ..session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def contact_updates(pages: DataFrame, order: Sequence[str] = ("page_id",), org_key: str | None = None,
                    want: Sequence[str] = FAMILIES,
                    blocklist: Sequence[str] = rules.EMAIL_BLOCKLIST, own_borders: bool = False) -> DataFrame:
    """Merged contacts of a page stream; in update mode each batch gives the changed ones."""
    found = contacts_of(pages, order, want, blocklist=blocklist, org_key=org_key, dedup=False, own_borders=own_borders)
    return best_contacts(found, [*order, "place"])


def write_log_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                    on_batch: Callable[[DataFrame, int], None] | None = None):
    """Keep a stream's results as a log of batches under ``path``.

    A batch overwrites its own folder, so a replay after a failure changes
    nothing.  ``on_batch`` is called with every batch after it is stored.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if on_batch is not None:
            on_batch(batch, batch_id)

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(store).start())


def read_log_table(spark: SparkSession, path: str, key: Sequence[str] | None = None) -> DataFrame:
    """Current rows of a log table: all, or the latest per key."""
    rows = spark.read.parquet(path)
    if key is None:
        return rows.drop("batch")
    return latest_by(rows, key, [F.desc("batch")]).drop("batch")


def request_rate(log: DataFrame, ts: str = "ts", width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Requests, failures and cache hits per time window (failed, from_cache)."""
    stamped = log.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", lateness)
    return (stamped.groupBy(F.window("__ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("failures"),
        F.count_if("from_cache").alias("cache_hits"))
        .select(F.col("w.start").alias("window_start"), "requests", "failures", "cache_hits"))


class _Ordered(StatefulProcessor):
    """One value of state per key, fed with a batch's rows in (ts, id) order.

    Keys are many and bring few rows each, so rows are plain ones: a frame per
    key would cost more than the key's work.  State is read and written once.
    """

    state_schema = "value double"

    def __init__(self, order: Sequence[str], output: Sequence[str]):
        self.order, self.output = list(order), list(output)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # nulls last
        rows = sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in self.order])
        found = self.state.get()
        start = found[0] if found is not None else None
        out, end = self.fold(rows, start)
        if end is not None and end != start:
            self.state.update((float(end),))
        self.moved(start, end)
        made = Row(*self.output)
        carried = [rows[0].__fields__.index(c) for c in self.output if c in rows[0].__fields__]
        for row, more in out:
            yield made(*[row[i] for i in carried], *more)

    def fold(self, rows: list[Row], start: float | None) -> tuple[list[tuple[Row, tuple]], float | None]:
        """Rows of the output, each with what is added to it, and the new state."""
        raise NotImplementedError

    def moved(self, before: float | None, after: float | None) -> None:
        pass

    def close(self) -> None:
        pass


class DelayState(_Ordered):
    """Per-host delay; equal to ``delay_series``."""

    def __init__(self, order, output, base: float):
        super().__init__(order, output)
        self.base = base

    def fold(self, rows, start):
        value, out = self.base if start is None else start, []
        for row in rows:
            value = next_delay(value, row["failed"], self.base)
            out.append((row, (round(value, 6),)))
        return out, value


class StrikeState(_Ordered):
    """Strikes in a row per proxy and whether it is burned; equal to ``strike_runs``/``burns``.

    A burned proxy is stored as a negative count, so the flag survives resets.
    """

    def __init__(self, order, output, limit: int):
        super().__init__(order, output)
        self.limit = limit

    def fold(self, rows, start):
        burned = start is not None and start < 0
        count, out = 0 if start is None else int(-start - 1 if burned else start), []
        for row in rows:
            kind = row["outcome"]
            count = count + 1 if kind == "strike" else 0 if kind == "reset" else count
            burned = burned or count >= self.limit
            out.append((row, (count, burned)))
        return out, -count - 1 if burned else count


class FetchGate(_Ordered):
    """Lets a key through when its last fetch is older than the TTL.

    Once the watermark has passed the end of a key's TTL, every request still
    to come is let through whether the last fetch is known or not; a timer at
    that moment drops the key, so the store holds no more than the keys fetched
    within one TTL.
    """

    def __init__(self, order, output, ttl_seconds: int):
        super().__init__(order, output)
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def _ends(self, last: float) -> int:
        """Milliseconds at which a fetch is older than the TTL."""
        return int((last + self.ttl) // 1000) + 1

    def moved(self, before, after) -> None:
        if after != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(after))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = self.state.get()
        if found is not None and self._ends(found[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def fold(self, rows, start):
        last, out = start, []
        for row in rows:
            us = row["ts_us"]
            if last is None or us - last > self.ttl:
                last = us
                out.append((row, ()))
        return out, last


def _stateful(rows: DataFrame, key: str, processor: _Ordered, schema: StructType | str, time_mode: str = "None") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(key).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time_mode)


def host_delays(log: DataFrame, key: str, order: Sequence[str], base: float = 0.1) -> DataFrame:
    """Delay after each fetch of a stream (key, order columns, failed)."""
    rows = log.select(key, *order, "failed")
    fields = [f"{n} {t}" for n, t in rows.dtypes]
    return _stateful(rows, key, DelayState(order, [*rows.columns, "delay"], base), ", ".join([*fields, "delay double"]))


def proxy_strikes(log: DataFrame, key: str, order: Sequence[str],
                  limit: int = rules.PROXY_BURN_STRIKES) -> DataFrame:
    """Strikes in a row and burn flag after each fetch of a stream (key, order columns, outcome)."""
    rows = log.where(F.col(key).isNotNull()).select(key, *order, "outcome")
    fields = [f"{n} {t}" for n, t in rows.dtypes]
    return _stateful(rows, key, StrikeState(order, [*rows.columns, "strikes", "burned"], limit),
                     ", ".join([*fields, "strikes bigint", "burned boolean"]))


def due_fetches(requests: DataFrame, key: str, order: Sequence[str], ts: str = "ts",
                ttl_seconds: int = rules.CACHE_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Requests of a stream that the page cache does not answer.

    Requests may come up to ``lateness`` after later ones; what comes later
    still than the watermark is dropped, as it cannot be put in order.
    """
    stamped = requests.select(key, *order, F.col(ts).cast("timestamp").alias("__ts")).withWatermark("__ts", lateness)
    rows = stamped.withColumn("ts_us", F.unix_micros("__ts"))
    out = [c for c in rows.columns if c != "__ts"]
    fields = ", ".join(f"{n} {t}" for n, t in rows.select(out).dtypes)
    return _stateful(rows, key, FetchGate(["ts_us", *[c for c in order if c != ts]], out, ttl_seconds), fields, "EventTime")


COUNTERS = "fetches"


def counted(log: DataFrame) -> DataFrame:
    """A stream of fetches (failed, from_cache, bytes) that counts what passes, without a second pass."""
    return log.observe(
        COUNTERS, F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("failures"),
        F.count_if("from_cache").alias("cache_hits"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


class LiveCounters(StreamingQueryListener):
    """Counters of every batch of ``counted`` streams, as their progress comes in.

    ``rows`` has one dict per batch and ``total`` their sums; a batch that is
    reported again after a restart replaces its first report.
    """

    def __init__(self) -> None:
        self.lock, self.batches, self.ended = threading.Lock(), {}, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(COUNTERS)
        if seen is not None:
            with self.lock:
                self.batches[str(event.progress.id), event.progress.batchId] = seen.asDict()

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    @property
    def rows(self) -> list[dict]:
        with self.lock:
            return [{"batch": n, **counts} for (_, n), counts in sorted(self.batches.items())]

    def total(self) -> dict[str, int]:
        rows = self.rows
        return {k: sum(r[k] for r in rows) for k in ("requests", "failures", "cache_hits", "bytes")}

    def wait(self, run_id: str, seconds: float = 30) -> None:
        """Until the events of a run that has ended have come in."""
        until = time.monotonic() + seconds
        while run_id not in self.ended and time.monotonic() < until:
            time.sleep(0.05)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", key: Sequence[str] | None = None,
                 arrivals: Sequence[Callable[[], None]] = (lambda: None,), counters: LiveCounters | None = None) -> DataFrame:
    """Run a stream over what its source holds and return the resulting table.

    Each of ``arrivals`` puts more into the source; the stream is run after
    each, as one batch that goes on from the state before.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    if counters is not None:
        spark.streams.addListener(counters)
    for arrive in arrivals:
        arrive()
        query = write_log_table(stream, f"{base}/table", f"{base}/progress", mode)
        query.awaitTermination()
        if counters is not None:
            counters.wait(str(query.runId))
    if counters is not None:
        spark.streams.removeListener(counters)
    return read_log_table(spark, f"{base}/table", key)

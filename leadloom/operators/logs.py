"""Fetch log operators: statistics, retries, strikes, adaptive delays, page cache.

Orders inside a host or proxy matter here, and a host may own any share of the
log, so order-dependent results come from range-partitioned passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from .scan import PART, border_summaries, range_partitioned


def outcome(status: Column, error: Column) -> Column:
    """``strike`` (retryable, proxy status or transport error), ``reset`` (success), ``neutral``."""
    transport = (F.coalesce(status, F.lit(0)) == 0) & error.isNotNull()
    return (F.when(status.isin(*rules.RETRYABLE_STATUS, *rules.PROXY_BURN_STATUS) | transport, "strike")
            .when(error.isNull() & (status < 400), "reset").otherwise("neutral"))


def fetch_statistics(log: DataFrame) -> DataFrame:
    """Run counters of a fetch log: ts, failed, retry, from_cache, bytes, emails."""
    elapsed = F.greatest(F.unix_micros(F.max("ts")) / 1e6 - F.unix_micros(F.min("ts")) / 1e6, F.lit(1e-9))
    n = F.count_if(F.expr("not from_cache"))
    return log.agg(
        n.alias("requests"), F.count_if("from_cache").alias("cache_hits"),
        F.count_if("failed").alias("failures"), F.count_if("retry").alias("retries"),
        F.round(F.sum("bytes") / 1048576, 2).alias("mb_down"),
        F.count_if(F.expr("not failed")).alias("pages_parsed"),
        F.sum("emails").alias("emails_found"),
        F.round(elapsed, 1).alias("elapsed_s"), F.round(n / elapsed, 2).alias("req_per_s"))


def retry_schedule(log: DataFrame, key: str, order: Sequence[str], max_tries: int = 3,
                   base: float = 0.6, ceiling: float = 12.0) -> DataFrame:
    """The first ``max_tries`` attempts per URL with the delay that follows each."""
    ranked = log.withColumn("attempt", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    kept = ranked.where(F.col("attempt") <= max_tries)
    return kept.withColumn("delay", F.when(F.col("attempt") < max_tries, F.round(F.least(
        F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(ceiling)), 6)))


def strike_runs(log: DataFrame, key: str, order: Sequence[str], kind: str = "outcome",
                partitions: int | None = None) -> DataFrame:
    """Add ``strikes``: strikes since the key's last reset, up to and including the row."""
    parts = range_partitioned(log.where(F.col(key).isNotNull()), [key], order, partitions)
    strike, reset = F.col(kind) == "strike", F.col(kind) == "reset"
    w = W.partitionBy(PART, key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = parts.withColumn("__island", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    rows = rows.withColumn("__local", F.sum(F.when(strike, 1).otherwise(0)).over(
        W.partitionBy(PART, key, "__island").orderBy(*order)
        .rowsBetween(W.unboundedPreceding, 0)))
    # what a partition's rows of a key leave behind: strikes after the last reset
    place = F.struct(*order)
    ends = border_summaries(parts, [key], [
        F.max(F.when(reset, place)).alias("__last_reset"), F.count_if(strike).alias("__all")])
    tails = (parts.join(F.broadcast(ends), [PART, key])
             .where(strike & (F.col("__last_reset").isNull() | (place > F.col("__last_reset"))))
             .groupBy(PART, key).agg(F.count(F.lit(1)).alias("__tail")))
    by_key = W.partitionBy(key).orderBy(PART)
    entering = (
        ends.join(tails, [PART, key], "left")
        .withColumn("__seg", F.sum(F.when(F.col("__last_reset").isNotNull(), 1).otherwise(0))
                    .over(by_key.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("__left", F.sum(F.coalesce("__tail", F.lit(0))).over(
            W.partitionBy(key, "__seg").orderBy(PART).rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("__in", F.lag("__left").over(by_key)).where("__in > 0")
        .select(PART, key, "__in"))
    # entering: at most one row per partition
    return (rows.join(F.broadcast(entering), [PART, key], "left")
            .withColumn("strikes", F.col("__local") + F.when(
                F.col("__island") == 0, F.coalesce("__in", F.lit(0))).otherwise(F.lit(0)))
            .drop(PART, "__island", "__local", "__in"))


def burns(log: DataFrame, key: str, order: Sequence[str], kind: str = "outcome",
          limit: int = rules.PROXY_BURN_STRIKES) -> DataFrame:
    """Keys with ``limit`` strikes in a row and where in the order they reached it."""
    runs = strike_runs(log, key, order, kind)
    return (runs.where((F.col(kind) == "strike") & (F.col("strikes") >= limit))
            .groupBy(key).agg(F.min(F.struct(*order)).alias("__at"))
            .select(key, *[F.col("__at")[c].alias(f"burned_{c}") for c in order]))


def next_delay(delay: float, failed, base: float) -> float:
    """One step of the delay: double on failure (1 to 30), decay towards the base on success."""
    if failed is None or failed != failed:
        return delay
    if failed:
        return min(max(delay * rules.DELAY_GROWTH, rules.DELAY_FLOOR_ON_FAILURE), rules.DELAY_CEILING)
    return max(base, delay * rules.DELAY_DECAY) if delay > base else delay


def delay_series(log: DataFrame, key: str, order: Sequence[str], failed: str = "failed",
                 base: float = 0.1, partitions: int | None = None) -> DataFrame:
    """Add ``delay``: the key's delay after each row (``failed`` null leaves it unchanged).

    Every step maps a delay x to min(hi, max(lo, a*x)), and such maps compose
    to one of the same form.  Each partition therefore reduces its part of a
    key to (a, lo, hi); composing those gives every partition its start value.
    """
    if not 0 <= base <= rules.DELAY_CEILING:
        raise ValueError("base delay must lie between 0 and the ceiling")
    parts = range_partitioned(log.where(F.col(key).isNotNull()), [key], order, partitions)
    key_type = dict(parts.dtypes)[key]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list[list] = []          # first and latest key only
        for pdf in batches:
            for part, k, f in zip(pdf[PART], pdf[key], pdf[failed].astype(object)):
                if not state or state[-1][1] != k:
                    del state[1:]
                    state.append([part, k, 1.0, base, float("inf")])
                if f is None or f != f:
                    continue
                entry = state[-1]
                entry[2] *= rules.DELAY_GROWTH if f else rules.DELAY_DECAY
                entry[3], entry[4] = next_delay(entry[3], f, base), next_delay(entry[4], f, base)
        if state:
            yield pd.DataFrame(state, columns=[PART, key, "a", "lo", "hi"])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PART)
        value, out = base, []
        for a, lo, hi in zip(pdf["a"], pdf["lo"], pdf["hi"]):
            out.append(value)
            value = min(hi, max(lo, a * value))
        return pdf[[PART, key]].assign(start=out)

    borders = parts.select(PART, key, failed).mapInPandas(
        summarise, f"{PART} int, {key} {key_type}, a double, lo double, hi double")
    # at most two rows per partition, so a key's group is bounded by the partition count
    entering = borders.groupBy(key).applyInPandas(starts, f"{PART} int, {key} {key_type}, start double")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, value = None, base
        for pdf in batches:
            out = []
            for k, f, start in zip(pdf[key], pdf[failed].astype(object), pdf["start"]):
                if k != current:
                    current, value = k, base if start != start else start
                value = next_delay(value, f, base)
                out.append(round(value, 6))
            yield pdf.drop(columns=[PART, "start"]).assign(delay=out)

    fields = ", ".join(f"`{n}` {t}" for n, t in parts.drop(PART).dtypes)
    return (parts.join(F.broadcast(entering), [PART, key], "left")
            .select(*parts.columns, "start").mapInPandas(walk, f"{fields}, delay double"))


def latest_cached(cache: DataFrame) -> DataFrame:
    """Newest good response per URL key: url_key, url, status, body, ts."""
    good = cache.where("status between 200 and 299 and coalesce(body, '') <> ''")
    newest = F.row_number().over(W.partitionBy("url_key").orderBy(F.desc("ts")))
    return good.withColumn("__r", newest).where("__r = 1").drop("__r")


def cache_lookup(requests: DataFrame, cache: DataFrame, ttl_seconds: int = rules.CACHE_TTL_SECONDS) -> DataFrame:
    """Requests (url_key, now) with the cached body where one is young enough (0: any age)."""
    c = latest_cached(cache).select("url_key", F.col("ts").alias("cached_ts"), F.col("body").alias("cached_body"))
    age = F.unix_micros("now") - F.unix_micros("cached_ts")
    fresh = F.col("cached_ts").isNotNull() & (
        F.lit(ttl_seconds == 0) | (age <= F.lit(ttl_seconds * 1_000_000)))
    joined = requests.join(c, "url_key", "left")
    return joined.withColumns({"hit": fresh, "cached_body": F.when(fresh, F.col("cached_body"))})

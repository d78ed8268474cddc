"""Keyed table maintenance: snapshot apply, recrawl selection, last-wins upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import interval_seconds


def apply_snapshot(old: DataFrame, new: DataFrame, key: str, payload: Sequence[str],
                   kept: Sequence[str] = ("uid", "created", "status")) -> DataFrame:
    """Declarative apply of ``new`` over ``old``; both have key and payload, old also
    ``generation`` and the ``kept`` columns, new may bring its own ``kept`` values.

    ``action`` is created, unchanged, configured or kept (only in old).
    """
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    was, now = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    same = F.lit(True)
    for c in payload:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    action = (F.when(~was, "created").when(~now, "kept").when(same, "unchanged").otherwise("configured"))
    own = set(new.columns)
    return j.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key),
        *[F.when(now, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in payload],
        (F.coalesce("o.generation", F.lit(0)) + F.when(action.isin("created", "configured"), 1)
         .otherwise(0)).alias("generation"),
        *[(F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in own else F.col(f"o.{c}")).alias(c)
          for c in kept],
        action.alias("action"))


def is_due(suspended: Column, running: Column, observed_generation: Column, generation: Column,
           schedule: Column, run_count: Column, next_run: Column, now: Column) -> Column:
    """Whether a target should be crawled again now (times in epoch seconds)."""
    interval = interval_seconds(schedule)
    timely = F.when(interval.isNull(), run_count == 0).otherwise(
        next_run.isNull() | (next_run == 0) | (now >= next_run))
    return ~suspended & ~running & ((observed_generation < generation) | timely)


def last_wins(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of tables where a later table's row replaces earlier ones with its key.

    Rows inside one table must have distinct keys.
    """
    union = None
    for i, table in enumerate(tables):
        t = table.withColumn("__v", F.lit(i))
        union = t if union is None else union.unionByName(t)
    newest = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__v")))
    return union.withColumn("__r", newest).where("__r = 1").drop("__v", "__r")


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key in an order."""
    r = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__r", r).where("__r = 1").drop("__r")


def first_occurrence(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Order-preserving deduplication: keys with the smallest sequence number."""
    return df.groupBy(*key).agg(F.min(seq).alias(seq))

"""Ordered passes over very large and very skewed groups.

A plain window puts a whole group into one task.  These passes range-partition
the table by (group, order) instead, so a group holding a third of all rows is
spread over many tasks.  Each partition is folded on its own; what the part of
a group in earlier partitions amounts to travels as one small carried row per
partition and group that crosses a partition border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

PART = "__part"


def range_partitioned(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by keys and order, with a stable partition number.

    The result is checkpointed: range borders come from sampling, so a lost
    task must reread the written partitions rather than sample again.
    """
    columns = [*keys, *order]
    ranged = (df.repartitionByRange(partitions, *columns) if partitions
              else df.repartitionByRange(*columns))
    return cut(ranged.sortWithinPartitions(*columns).withColumn(PART, F.spark_partition_id()))


def carried(summaries: DataFrame, keys: Sequence[str], values: dict) -> DataFrame:
    """State entering each (partition, group) from the group's earlier partitions.

    ``summaries`` has one row per (partition, group).  Only a partition's first
    group can have begun earlier, so at most one row per partition remains.
    """
    w = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return (summaries.select(PART, *keys, *[expr(w).alias(name) for name, expr in values.items()],
                             F.lag(PART).over(W.partitionBy(*keys).orderBy(PART)).alias("__prev"))
            .where(F.col("__prev").isNotNull()).drop("__prev"))


def border_summaries(parts: DataFrame, keys: Sequence[str], aggregates: Sequence) -> DataFrame:
    """One row per (partition, group), only for groups that span partitions.

    A group spans partitions when a partition other than its first holds it.
    """
    per_part = parts.groupBy(PART, *keys).agg(*aggregates)
    spanning = (parts.groupBy(*keys)
                .agg(F.min(PART).alias("__lo"), F.max(PART).alias("__hi"))
                .where("__lo < __hi").select(*keys))
    return per_part.join(spanning, list(keys), "left_semi")


def with_group_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank of each row inside its group; ``order`` must be unique per group."""
    parts = range_partitioned(df, keys, order, partitions)
    offsets = carried(
        border_summaries(parts, keys, [F.count(F.lit(1)).alias("__n")]), keys,
        {"__offset": lambda w: F.sum("__n").over(w)})
    local = F.row_number().over(W.partitionBy(PART, *keys).orderBy(*order))
    # offsets: at most one row per partition, so its size is bounded by the partition count
    return (parts.withColumn("__local", local)
            .join(F.broadcast(offsets), [PART, *keys], "left")
            .withColumn(out, F.col("__local") + F.coalesce("__offset", F.lit(0)))
            .drop(PART, "__local", "__offset"))

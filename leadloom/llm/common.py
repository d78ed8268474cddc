"""Helpers shared by the training-data operators: staged tables, text slices, hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir

U64 = np.uint64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name on the storage that the driver and all executors share."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


class Stage:
    """Tables written to shared storage so that a plan is cut and a lost executor costs no recompute.

    ``put`` writes a DataFrame as Parquet and reads it back; ``drop`` deletes
    what no later plan reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, shared_folder(spark, name), 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def slices(texts: list, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch holding about ``most_bytes`` characters each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def slices_of(texts: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """As ``slices``, for a column that has not become Python strings: a batch need not do so as a whole."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


# Multipliers of the splitmix64 finaliser.
_GOLDEN, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        z = x + _GOLDEN
        z = (z ^ (z >> U64(30))) * _M1
        z = (z ^ (z >> U64(27))) * _M2
        return z ^ (z >> U64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def components(spark: SparkSession, edges: DataFrame, stage: Stage) -> DataFrame:
    """Connected components of ``edges(a, b)``: columns id, component (smallest id reachable).

    Union-find with the labels in a table: every round each node takes the
    smallest label among its neighbours (a partial aggregate, so a hub is no
    hot key) and then its label's label.  Chains halve per round.  Only ids
    that have an edge are returned.
    """
    both = stage.put(edges.select("a", "b").where("a <> b")
                     .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
                     .distinct(), "edges")
    labels = stage.put(both.groupBy(F.col("a").alias("id"))
                       .agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("near_id"))
                .agg(F.min("label").alias("near")))
        lower = (labels.join(near, F.col("id") == F.col("near_id"), "left")
                 .select("id", F.col("label").alias("old"),
                         F.least("label", F.coalesce("near", "label")).alias("label")))
        lower = stage.put(lower, "lower")
        up = lower.select(F.col("id").alias("up_id"), F.col("label").alias("up"))
        new = stage.put(lower.join(up, F.col("label") == F.col("up_id"), "left")
                        .select("id", "old", F.coalesce("up", "label").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        stage.drop(labels)
        stage.drop(lower)
        labels = new
        if not changed:
            stage.drop(both)
            return labels.select("id", F.col("label").alias("component"))


def broadcast_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` (a staged table) marked for broadcast if it has at most ``most_rows`` rows, else unchanged."""
    return F.broadcast(df) if df.count() <= most_rows else df


def row_key(doc_id="doc_id", text="text") -> dict:
    """Columns that name a document row, also one whose id is null or repeated."""
    doc_id = F.col(doc_id).cast("long")
    return {"__id": F.coalesce(doc_id, F.lit(0)), "__no_id": doc_id.isNull(),
            "__text": F.xxhash64(F.col(text).cast("string"))}

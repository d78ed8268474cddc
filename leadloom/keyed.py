"""Stored tables with a key: upserts rewrite only the buckets that a batch touches.

Rows lie in folders by a hash of their key.  An upsert reads the touched
buckets, lets the batch's rows replace those with their key, stores the result
on reliable storage and then overwrites just these folders (a dynamic partition
overwrite, so files of other buckets stay as they are).  A job that fails
before the overwrite leaves the table unchanged; run again, an upsert gives
the same table.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .operators.upsert import apply_snapshot, last_wins
from .session import cut

BUCKET = "bucket"
#: Folder of a table's description, beside its rows.
_MADE = "table"


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` with distinct rows per ``key`` in ``buckets`` folders."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int
    schema: StructType

    @staticmethod
    def create(rows: DataFrame, path: str, key: Sequence[str], buckets: int = 64) -> "KeyedTable":
        """Store ``rows`` (distinct keys) as a new table.

        Choose ``buckets`` so that one holds what a task can merge, about
        100 to 200 MB; the number stays with the table.
        """
        if exists(rows.sparkSession, path):
            raise ValueError(f"{path} holds a table")
        table = KeyedTable(rows.sparkSession, path, tuple(key), buckets, rows.schema)
        table._write(rows.withColumn(BUCKET, table._bucket()), "static")
        made = json.dumps({"key": list(key), "buckets": buckets, "schema": rows.schema.jsonValue()})
        # last: without it the folder is no table, and a second try replaces what a failed one left
        rows.sparkSession.createDataFrame([(made,)], "value string").coalesce(1).write.text(f"{path}/{_MADE}")
        return table

    @staticmethod
    def open(spark: SparkSession, path: str) -> "KeyedTable":
        """A table stored before, with the key and buckets it was made with."""
        made = json.loads(spark.read.text(f"{path}/{_MADE}").head().value)
        return KeyedTable(spark, path, tuple(made["key"]), made["buckets"], StructType.fromJson(made["schema"]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])) \
            .parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """All rows."""
        return self._stored().drop(BUCKET)

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """Rows with one of the given keys; only their buckets are read."""
        keys = keys.select(*self.key).withColumn(BUCKET, self._bucket())
        return (self._stored().where(F.col(BUCKET).isin(self._touched(keys)))
                .join(keys.drop(BUCKET), list(self.key), "left_semi").drop(BUCKET))

    @staticmethod
    def _touched(batch: DataFrame) -> list[int]:
        # no more numbers than the table has buckets
        return [r[0] for r in batch.select(BUCKET).distinct().collect()]

    def _write(self, rows: DataFrame, overwritten: str) -> None:
        # one task per bucket; a sort inside it lets readers skip by the key's ranges
        (rows.select(*self.schema.names, BUCKET).repartition(self.buckets, BUCKET).sortWithinPartitions(BUCKET, *self.key)
         .write.mode("overwrite").option("partitionOverwriteMode", overwritten).partitionBy(BUCKET)
         .parquet(f"{self.path}/rows"))

    def _merge(self, batch: DataFrame, merged) -> DataFrame:
        """Write ``merged(current rows of the touched buckets, batch)`` over them; returns it, staged."""
        if any(c not in batch.columns for c in self.key):
            raise ValueError(f"a batch needs the key {self.key}")
        new = cut(batch.withColumn(BUCKET, self._bucket()))
        touched = self._touched(new)
        if not touched:
            return merged(self._stored().where("false"), new)
        out = cut(merged(self._stored().where(F.col(BUCKET).isin(touched)), new))
        self._write(out, "dynamic")
        return out

    def upsert(self, batch: DataFrame) -> None:
        """Insert rows, or replace those with their key.  Keys in ``batch`` are distinct; columns are the table's."""
        columns = [*self.schema.names, BUCKET]
        self._merge(batch, lambda old, new: last_wins([old.select(*columns), new.select(*columns)], self.key))

    def apply(self, batch: DataFrame, payload: Sequence[str], kept: Sequence[str] = ("uid", "created", "status"),
              ) -> DataFrame:
        """Apply a snapshot (see ``apply_snapshot``) to a table with one key column; actions of the batch's keys.

        Rows that the batch lacks are kept, most of them without being read.
        """
        (key,) = self.key
        out = self._merge(batch, lambda old, new: apply_snapshot(old.drop(BUCKET), new.drop(BUCKET), key, payload, kept)
                          .withColumn(BUCKET, self._bucket()))
        return out.where("action <> 'kept'").select(key, "action", "generation")


def exists(spark: SparkSession, path: str) -> bool:
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_MADE}/_SUCCESS")
    return made.getFileSystem(spark._jsc.hadoopConfiguration()).exists(made)


def upsert_or_create(rows: DataFrame, path: str, key: Sequence[str], buckets: int = 64) -> KeyedTable:
    """``rows`` upserted into the table at ``path``, which is made where there is none."""
    if not exists(rows.sparkSession, path):
        return KeyedTable.create(rows, path, key, buckets)
    table = KeyedTable.open(rows.sparkSession, path)
    table.upsert(rows)
    return table

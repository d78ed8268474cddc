"""Page cache: good responses by URL key, bodies compressed, in a keyed table on shared storage.

The table is Parquet in folders by a hash of the key.  A Python data source
would open its files itself and so reach no store that only Spark's readers
know; here key, time and status filters go into Spark's own scan (folders and
row groups are skipped), and only the bodies of rows that pass are unpacked.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StringType

from .. import rules
from ..functions.urls import cache_key
from ..keyed import BUCKET, KeyedTable, exists, upsert_or_create
from ..operators.pages import is_ok_response
from .tables import spread

KEY = "url_key"
#: Compression level of bodies.
LEVEL = 5


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Texts as gzip members of their UTF-8; equal texts give equal bytes."""
    return texts.map(lambda t: gzip.compress(t.encode("utf-8", "ignore"), LEVEL, mtime=0), na_action="ignore")


@F.pandas_udf(StringType())
def unpacked(bodies: pd.Series) -> pd.Series:
    """Texts of gzip bodies; null where a body is damaged."""
    def text(body: bytes) -> str | None:
        try:
            return gzip.decompress(body).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None
    return bodies.map(text, na_action="ignore")


def put(responses: DataFrame, path: str, buckets: int = 64) -> KeyedTable:
    """Store the good ones of ``responses(url, status, text, ts[, error])``; a later call replaces a URL's entry.

    Good is a status of 200 to 299, no error and a text that is not empty;
    others, and rows without a url or time, leave the cache as it is.  Of a
    URL's rows in one call the newest is stored; of equally new ones that with
    the smallest status, then MD5 of the text.  Bodies are packed before they are
    shuffled.
    """
    error = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    good = responses.where(is_ok_response(F.col("status"), F.col("text"), error) & F.col("url").isNotNull()
                           & F.col("ts").isNotNull())
    good = good.select("url", F.col("status").cast("int").alias("status"), F.col("ts").cast("timestamp").alias("ts"),
                       F.md5("text").alias("__sum"), packed("text").alias("body"))
    newest = F.min_by(F.struct("url", "status", "ts", "body"), F.struct(-F.unix_micros("ts"), "status", "__sum"))
    one = good.groupBy(cache_key(F.col("url")).alias(KEY)).agg(newest.alias("r")).select(KEY, "r.*")
    return upsert_or_create(one, path, [KEY], buckets)


def stored(spark: SparkSession, path: str, urls: Sequence[str] | None = None, since=None) -> DataFrame:
    """Cached entries with packed bodies: url_key, url, status, ts, body; of the given URLs, and not older than ``since``."""
    table = KeyedTable.open(spark, path)
    rows = table._stored()
    if urls is not None:
        asked = spark.createDataFrame([(u,) for u in urls], "url string").select(cache_key(F.col("url")).alias(KEY))
        found = asked.select(KEY, table._bucket().alias(BUCKET)).distinct().collect()  # as many as the caller's list
        rows = rows.where(F.col(BUCKET).isin(sorted({r[BUCKET] for r in found})) & F.col(KEY).isin([r[KEY] for r in found]))
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since))
    return rows.drop(BUCKET)


def pages(spark: SparkSession, path: str, urls: Sequence[str] | None = None, since=None) -> DataFrame:
    """Cached pages as snapshots: url, status, ts, html.  Entries with a damaged body are left out."""
    held = spread(stored(spark, path, urls, since))
    return held.select("url", "status", "ts", unpacked("body").alias("html")).where("html is not null")


def lookup(requests: DataFrame, path: str, ttl_seconds: int = rules.CACHE_TTL_SECONDS,
           broadcast_keys: int = 500_000) -> DataFrame:
    """``requests(url, now)`` with hit, cached_status and cached_text from the cache at ``path``.

    An entry counts while it is at most ``ttl_seconds`` old (0: for ever); a
    damaged body is a miss, as is everything where there is no cache yet.  Only
    the folders of requested keys are read, and bodies are unpacked once per
    entry, for entries that some request finds young enough.  Keys are
    broadcast up to ``broadcast_keys``, so that bodies stay where they are
    read until the hits are joined.  Rows without a url or time are misses.
    """
    spark = requests.sparkSession
    asked = requests.withColumn(KEY, cache_key(F.col("url"))).withColumn("__now", F.col("now").cast("timestamp"))
    missing = {"hit": F.lit(False), "cached_status": F.lit(None).cast("int"), "cached_text": F.lit(None).cast("string")}
    if not exists(spark, path):
        return requests.withColumns(missing)
    table = KeyedTable.open(spark, path)
    # the earliest request of a key decides whether anyone can use its entry
    first = asked.where(f"{KEY} is not null and __now is not null").groupBy(KEY).agg(F.min("__now").alias("first"))
    first = first.withColumn(BUCKET, table._bucket())
    folders = [r[0] for r in first.select(BUCKET).distinct().collect()]  # no more than the table has buckets
    few = F.broadcast(first.drop(BUCKET)) if first.count() <= broadcast_keys else first.drop(BUCKET)
    young = F.lit(ttl_seconds == 0) | (F.unix_micros("first") - F.unix_micros("ts") <= F.lit(ttl_seconds * 1_000_000))
    entries = (table._stored().where(F.col(BUCKET).isin(folders)).join(few, KEY).where(young)
               .select(KEY, F.col("status").alias("cached_status"), F.col("ts").alias("__ts"),
                       unpacked("body").alias("cached_text")).where("cached_text is not null"))
    fresh = F.lit(ttl_seconds == 0) | (F.unix_micros("__now") - F.unix_micros("__ts") <= F.lit(ttl_seconds * 1_000_000))
    hit = F.coalesce(F.col("__ts").isNotNull() & F.col("__now").isNotNull() & fresh, F.lit(False))
    joined = asked.join(entries, KEY, "left").withColumn("hit", hit)
    return joined.select(*[F.col(c) for c in requests.columns], "hit", *[
        F.when(F.col("hit"), F.col(c)).alias(c) for c in ("cached_status", "cached_text")])

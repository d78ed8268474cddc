"""A stored page corpus, bucketed by canonical URL, that crawl rounds look pages up in.

The HTML is shuffled once, when the corpus is stored.  A round then moves only
its frontier to the buckets' tasks; a small frontier also reads no more than
its own buckets and row groups.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import with_normalised_url
from ..session import checkpoint_dir

#: URLs of a frontier that are handed to the scan as a filter; a larger one is joined without.
LOOKUP = 1000


def corpus_by_url(pages: DataFrame, url: str = "url", html: str = "html", partitions: int | None = None) -> DataFrame:
    """Corpus keyed by canonical URL; of several captures of a URL the first by content order."""
    keyed = with_normalised_url(pages.select(url, html), url, "url_key").where("url_key is not null")
    if partitions:
        keyed = keyed.repartition(partitions, "url_key")
    return (keyed.groupBy("url_key").agg(F.min(F.struct(F.col(url).alias("u"), F.col(html).alias("h"))).alias("first"))
            .select(F.col("url_key").alias("url"), F.col("first.h").alias("html")))


@dataclass(frozen=True)
class StoredCorpus:
    """Pages (url, html) with one row per canonical URL, as a bucketed table."""

    spark: SparkSession
    table: str

    @staticmethod
    def store(pages: DataFrame, buckets: int = 256, url: str = "url", html: str = "html", table: str | None = None,
              folder: str | None = None) -> "StoredCorpus":
        """Write ``pages`` as a bucketed table; choose ``buckets`` so that one holds about 128 MB.

        Without ``folder`` the files go to the shared checkpoint folder.
        """
        spark = pages.sparkSession
        table = table or f"page_corpus_{uuid.uuid4().hex}"
        (corpus_by_url(pages, url, html, buckets).write.bucketBy(buckets, "url").sortBy("url")
         .option("path", f"{folder or checkpoint_dir(spark) + '/corpus'}/{table}").saveAsTable(table))
        return StoredCorpus(spark, table)

    def fetch(self, frontier: DataFrame) -> DataFrame:
        """``frontier`` (a stored table with ``url``) with the ``html`` of each URL, null where the corpus lacks it."""
        pages = self.spark.table(self.table)
        few = [r.url for r in frontier.select("url").distinct().limit(LOOKUP + 1).collect()]
        if len(few) <= LOOKUP:
            pages = pages.where(F.col("url").isin(few))
        # both sides sorted by bucket: the corpus is read where it lies
        return frontier.join(pages.hint("merge"), "url", "left")


def pages_at(corpus: "StoredCorpus | DataFrame", frontier: DataFrame) -> DataFrame:
    """Pages of a frontier in a stored corpus, or in a plain table (url, html) by an ordinary join."""
    return corpus.fetch(frontier) if isinstance(corpus, StoredCorpus) else frontier.join(corpus, "url", "left")

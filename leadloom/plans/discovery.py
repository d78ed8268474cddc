"""Seeds: unions, grouping, fallbacks, safety filter, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.urls import (
    is_scrapeable, registrable_domain, with_block_reason, with_normalised_url)


def explicit_urls(df: DataFrame, raw: str) -> DataFrame:
    """Canonical form of targets a user gave, adding ``https://`` where no scheme is written."""
    full = F.when(F.col(raw).contains("://"), F.col(raw)).otherwise(F.concat(F.lit("https://"), F.col(raw)))
    return with_normalised_url(df.withColumn("__full", full), "__full", "url").drop("__full").where("url is not null")


def seed_union(sources: Sequence[DataFrame]) -> DataFrame:
    """Ordered union of seed tables (url, seq): earlier tables first, first occurrence kept."""
    union = None
    for i, s in enumerate(sources):
        t = s.select("url", F.struct(F.lit(i).alias("source"), F.col("seq").cast("bigint").alias("seq")).alias("o"))
        union = t if union is None else union.unionByName(t)
    return (union.where(F.coalesce(is_scrapeable(F.col("url")), F.lit(False))).groupBy("url")
            .agg(F.min("o").alias("o")).select("url", "o.source", "o.seq"))


def first_available(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Per key the rows of the first table that has any."""
    union = None
    for i, t in enumerate(tables):
        t = t.withColumn("choice", F.lit(i))
        union = t if union is None else union.unionByName(t)
    best = union.groupBy(key).agg(F.min("choice").alias("choice"))
    return union.join(best, [key, "choice"], "left_semi")


def safe_urls(df: DataFrame, url: str = "url", allow_private: bool = False) -> DataFrame:
    return with_block_reason(df, url, "__r", allow_private).where("__r is null").drop("__r")


def blocked_summary(df: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """How many targets are blocked and the first of them."""
    b = with_block_reason(df, url, "__r").where("__r is not null")
    return b.agg(F.count(F.lit(1)).alias("blocked"), F.min_by(url, seq).alias("first_blocked"))


def seeds_by_domain(seeds: DataFrame, order: Sequence[str]) -> DataFrame:
    """Scrapeable, distinct seeds with their domain, in long form: url, domain, order columns."""
    first = seeds.groupBy("url").agg(F.min(F.struct(*order)).alias("o"))
    return (first.where(is_scrapeable(F.col("url")))
            .select("url", registrable_domain(F.col("url")).alias("domain"), "o.*").where("domain <> ''"))


def first_seeds(seeds: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first ``n`` seeds of each domain."""
    r = F.row_number().over(W.partitionBy("domain").orderBy(*order))
    return seeds.withColumn("rank", r).where(F.col("rank") <= n)


def unfinished(targets: DataFrame, done: DataFrame, key: str = "domain") -> DataFrame:
    return targets.join(done.select(key).distinct(), key, "left_anti")


def first_writer(leads: Sequence[DataFrame], key: str = "domain") -> DataFrame:
    """Leads of several sources; the first source that has a domain wins, '' is skipped."""
    union = None
    for i, t in enumerate(leads):
        t = t.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("__p", F.lit(i))
        union = t if union is None else union.unionByName(t)
    r = F.row_number().over(W.partitionBy(key).orderBy("__p"))
    return union.withColumn("__r", r).where("__r = 1").drop("__r", "__p")


def site_queue(contact_pages: Sequence[DataFrame], seeds: DataFrame, seen: DataFrame) -> DataFrame:
    """Pages to visit per domain: found contact pages (scrapeable, unseen) first, then seeds.

    All tables have domain, url, seq.
    """
    tables = [t.where(is_scrapeable(F.col("url"))) for t in contact_pages] + [seeds]
    union = None
    for i, t in enumerate(tables):
        t = t.select("domain", "url", F.struct(F.lit(i).alias("source"), F.col("seq").cast("bigint").alias("seq")).alias("o"))
        union = t if union is None else union.unionByName(t)
    return (union.join(seen.select("url").distinct(), "url", "left_anti")
            .groupBy("domain", "url").agg(F.min("o").alias("o")).select("domain", "url", "o.source", "o.seq"))

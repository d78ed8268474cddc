"""Fetch log operators over the event table: users stand for hosts and proxies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as G
from ..sources import captures as CA
from .base import register, scratch, table

_OUTCOME = "CASE event_type WHEN 'error' THEN 'strike' WHEN 'view' THEN 'neutral' ELSE 'reset' END"
_FAILED = "CASE event_type WHEN 'error' THEN TRUE WHEN 'view' THEN NULL ELSE FALSE END"
#: Half of the events belong to one host.
_KEY = "CASE WHEN user_id % 2 = 0 THEN -1 ELSE user_id END"


def _log(spark, sf):
    return table(spark, sf, "events").selectExpr(
        f"{_KEY} AS host", "user_id", "ts", "event_id", f"{_OUTCOME} AS outcome", f"{_FAILED} AS failed")


def strikes_sql(key: str) -> str:
    return (f"(SELECT host, ts, event_id, outcome, sum(CASE outcome WHEN 'strike' THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY ts, event_id)::BIGINT AS strikes "
            f"FROM (SELECT *, sum(CASE outcome WHEN 'reset' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id) AS island FROM "
            f"(SELECT {key} AS host, ts, event_id, {_OUTCOME} AS outcome FROM events)))")


def delays_sql(key: str) -> str:
    """The delay series as a fold over each host's outcomes in order."""
    step = "CASE WHEN f IS NULL THEN d WHEN f THEN least(greatest(d * 2, 1.0), 30.0) WHEN d > 0.1 THEN greatest(0.1, d * 0.8) ELSE d END"
    return (f"(WITH RECURSIVE o AS (SELECT {key} AS host, event_id, {_FAILED} AS f, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events), "
            f"r AS (SELECT host, n, event_id, CASE WHEN f THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS d FROM o WHERE n = 1 UNION ALL "
            f"SELECT o.host, o.n, o.event_id, {step} FROM r JOIN o ON o.host = r.host AND o.n = r.n + 1) SELECT host, event_id, round(d, 6) AS delay FROM r)")


@register("win6_strike_runs", f"SELECT event_id, host, strikes FROM {strikes_sql(_KEY)}")
def _(spark, sf):
    return G.strike_runs(_log(spark, sf), "host", ["ts", "event_id"]).select("event_id", "host", "strikes")


@register("win6_burned", f"SELECT host, min(event_id) AS burned_event_id FROM {strikes_sql('user_id')} WHERE outcome = 'strike' AND strikes >= 3 GROUP BY 1")
def _(spark, sf):
    log = _log(spark, sf).drop("host").withColumnRenamed("user_id", "host")
    return G.burns(log, "host", ["ts", "event_id"]).select("host", "burned_event_id")


@register("win7_delay_series", f"SELECT host, event_id, delay FROM {delays_sql(_KEY)}")
def _(spark, sf):
    return G.delay_series(_log(spark, sf), "host", ["ts", "event_id"]).select("host", "event_id", "delay")


@register("win7_delay_per_host", f"SELECT host, event_id, delay FROM {delays_sql('user_id')}")
def _(spark, sf):
    log = _log(spark, sf).drop("host").withColumnRenamed("user_id", "host")
    return G.delay_series(log, "host", ["ts", "event_id"]).select("host", "event_id", "delay")


@register("win10_retries", """SELECT user_id, event_id, attempt::INT AS attempt, CASE WHEN attempt < 4 THEN round(least(0.6 * pow(2.0, attempt - 1), 12.0), 6)::DOUBLE END AS delay
    FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events) WHERE attempt <= 4""")
def _(spark, sf):
    return G.retry_schedule(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 4).select("user_id", "event_id", "attempt", "delay")


@register("agg16_fetch_statistics", """SELECT count(*) FILTER (NOT c) AS requests, count(*) FILTER (c) AS cache_hits, count(*) FILTER (f) AS failures, count(*) FILTER (r) AS retries,
    round(sum(b) / 1048576.0::DOUBLE, 2) AS mb_down, count(*) FILTER (NOT f) AS pages_parsed, sum(e)::BIGINT AS emails_found,
    round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 1)::DOUBLE AS elapsed_s, round(count(*) FILTER (NOT c) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 2)::DOUBLE AS req_per_s
    FROM (SELECT ts, event_type = 'error' AS f, event_id % 6 = 0 AS c, event_type = 'error' AND event_id % 2 = 0 AS r, (event_id % 1000) * 100 AS b, event_id % 3 AS e FROM events)""")
def _(spark, sf):
    log = table(spark, sf, "events").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts", "event_type = 'error' AS failed", "event_id % 6 = 0 AS from_cache",
        "event_type = 'error' AND event_id % 2 = 0 AS retry", "(event_id % 1000) * 100 AS bytes", "event_id % 3 AS emails")
    return G.fetch_statistics(log)


@register("jn5_cache_lookup", """SELECT event_id, c.cts IS NOT NULL AND ts - c.cts <= INTERVAL 1 DAY AS hit, CASE WHEN ts - c.cts <= INTERVAL 1 DAY THEN c.body END AS body FROM events e
    LEFT JOIN (SELECT user_id, max(ts) AS cts, first(concat('body', event_id) ORDER BY ts DESC) AS body FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0 GROUP BY 1) c USING (user_id)""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    key = F.col("user_id").alias("url_key")
    cache = e.where("event_type = 'purchase'").select(
        key, F.lit("u").alias("url"), F.when(F.col("event_id") % 4 == 0, 503).otherwise(200).alias("status"),
        F.concat(F.lit("body"), F.col("event_id").cast("string")).alias("body"), "ts")
    found = G.cache_lookup(e.select("event_id", key, F.col("ts").alias("now")), cache)
    return found.select("event_id", "hit", F.col("cached_body").alias("body"))


_CACHED_AT, _ASKED_AT = "1700000000 + page_id % 7 * 3600", "1700000000 + page_id % 5 * 40000"


@register("jn5_page_cache", f"""WITH first AS (SELECT url, 200 + page_id % 3 AS status, html AS text, {_CACHED_AT} AS t FROM pages WHERE page_id % 10 <> 4 AND html <> ''),
    again AS (SELECT url, 200 AS status, html || '<!-- again -->' AS text, {_CACHED_AT} + 50000 AS t FROM pages WHERE page_id % 3 = 0),
    cache AS (SELECT url, first(struct_pack(status := status, text := text, t := t) ORDER BY again DESC, t DESC, status, md5(text)) AS c FROM
      (SELECT *, 0 AS again FROM first UNION ALL SELECT *, 1 FROM again) GROUP BY url)
    SELECT page_id, coalesce({_ASKED_AT} - c.t <= 86400, FALSE) AS hit, CASE WHEN {_ASKED_AT} - c.t <= 86400 THEN c.status::INTEGER END AS status,
      CASE WHEN {_ASKED_AT} - c.t <= 86400 THEN md5(c.text) END AS digest FROM pages LEFT JOIN cache USING (url)""")
def _(spark, sf):
    """Two rounds of captures put into one cache, then a request for every page."""
    pages, path = table(spark, sf, "pages"), scratch(spark, "captures")
    at = F.expr(_CACHED_AT)
    CA.put(pages.select("url", F.expr("CASE WHEN page_id % 10 = 4 THEN 503 ELSE 200 + page_id % 3 END").alias("status"),
                        F.col("html").alias("text"), F.timestamp_seconds(at).alias("ts")), path, buckets=16)
    CA.put(pages.where("page_id % 3 = 0").select("url", F.lit(200).alias("status"), F.concat("html", F.lit("<!-- again -->")).alias("text"),
                                                 F.timestamp_seconds(at + 50000).alias("ts")), path)
    found = CA.lookup(pages.select("page_id", "url", F.timestamp_seconds(F.expr(_ASKED_AT)).alias("now")), path)
    return found.select("page_id", "hit", F.col("cached_status").alias("status"), F.md5("cached_text").alias("digest"))
